"""Quasi-identifiers: how an attribute is read, and who can know it for everybody.

``REGISTER``: anyone, from a register of the whole population; counted exactly.
``OBSERVABLE``: anyone who looks; no register, so its frequency is estimated.
``INSIDER``: only some parties; also estimated.
An attacker of level X knows everything up to X.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import Column

from .functions import cleaning as clean
from .functions import constraints as con


class Knowledge(IntEnum):
    REGISTER = 1
    OBSERVABLE = 2
    INSIDER = 3


NUMERIC, CATEGORICAL = "numeric", "categorical"


@dataclass(frozen=True)
class QidSpec:
    """How to read one attribute, and in which population column it can be looked up (None: in
    no register, so its frequency is estimated)."""

    key: str
    kind: str
    knowledge: Knowledge = Knowledge.REGISTER
    population_column: str | None = None
    label: str = ""
    integer: bool = True
    normalise: Callable[[Column], Column] | None = None
    domain: tuple = ()

    def parse(self, value: Column, on_error: Column | None = None) -> Column:
        if self.kind == NUMERIC:
            return con.parse_numeric(value, integer=self.integer, on_error=on_error)
        return con.parse_categorical(value, normalise=self.normalise, on_error=on_error)


@dataclass(frozen=True)
class Qid:
    """A dataset column read as a quasi-identifier. ``tolerance``: published values may be off by
    that much (a grid cell: in kilometres); ``reading``: rounding and shared boundaries."""

    column: str
    spec: QidSpec
    tolerance: float = 0.0
    reading: con.Reading | None = None

    @property
    def counted(self) -> bool:
        return self.spec.population_column is not None

    @property
    def numeric(self) -> bool:
        return self.spec.kind == NUMERIC

    def constraint(self, value: Column, *, attacker: bool = True,
                   on_error: Column | None = None) -> Column:
        """The constraint as published, or (``attacker``) as an attacker should read it."""
        c = self.spec.parse(value, on_error)
        if not attacker:
            return c
        if self.reading is not None and self.numeric:
            c = self.reading.apply(c, integer=self.spec.integer)
        if self.tolerance and self.spec.key == "h3_cel":
            from .functions import geo
            return geo.widen_cells(c, self.tolerance)
        return con.widen(c, self.tolerance) if self.numeric else c

    def with_(self, **changes) -> Qid:
        return replace(self, **changes)


def custom(key: str, kind: str, knowledge: Knowledge = Knowledge.INSIDER, *,
           population_column: str | None = None, integer: bool = True, normalise=None,
           domain: tuple = ()) -> QidSpec:
    """An attribute the catalogue does not know."""
    if normalise is None and kind == CATEGORICAL:
        normalise = clean.free_text
    return QidSpec(key, kind, knowledge, population_column, key, integer, normalise, domain)


# --- names --------------------------------------------------------------------------------------

# Outputs of the heat signature with the unit their column carries, its methods,
# and the grid levels of the population.
OUTPUT_UNITS = {"H": "W_K_1", "C": "Wh_K_1", "tau": "h", "Asol": "m2", "Ainf": "cm2"}
METHODS = ("nta8800", "mwa", "best", "ep", "ep_3dbag", "passend", "ep_cbag", "passend_cbag")
CELL_LEVELS = (4, 5, 6, 7, 8)


def output_column(output: str) -> str:
    return f"{output}__{OUTPUT_UNITS[output]}"


def signature_column(output: str, method: str = "nta8800") -> str:
    stem = "sig" if method == "nta8800" else f"sig_{method}"
    return f"{stem}_{output_column(output)}"


def cell_column(level: int) -> str:
    return f"h3_r{level}__str"


# Population columns with the unit or type suffix they carry now; an older file
# has the part before the double underscore as the name.
_PLAIN = (
    "vbo_id__str", "nummeraanduiding_id__str", "pand_id__str", "postcode6__str", "postcode4__str",
    "huisnummer__str", "huisletter__str", "toevoeging__str", "woonplaats__cat",
    "gemeente_code__str", "gemeente__cat", "provincie__cat", "status__cat", "bouwjaar__yr",
    "oppervlakte__m2", "pand_woningen__0", "eengezins__bool", "rd_x__m", "rd_y__m", "lat__degN",
    "lon__degE", "energielabel__cat", "woningtype__cat", "woningtype_bron__cat",
    "energie_index__0", "compactheid__m2_m_2", "label_oppervlakte__m2",
    "warmtebehoefte__kWh_m_2_a_1", "nta8800__bool", "daktype__cat", "bouwlagen__0", "hoogte__m",
    "aaneengebouwd__bool", "pand_volume__m3", "opp_grond__m2", "opp_dak_plat__m2",
    "opp_dak_schuin__m2", "opp_buitenmuur__m2", "opp_scheidingsmuur__m2", "uhi__degC",
    "knmi_station__cat",
)
RENAMED = {c.split("__", 1)[0]: c for c in _PLAIN}
RENAMED |= {f"h3_r{n}": cell_column(n) for n in CELL_LEVELS}
RENAMED |= {f"sig_{o}": signature_column(o) for o in OUTPUT_UNITS}
RENAMED |= {f"sig_{m}_{o}": f"sig_{m}_{output_column(o)}" for m in METHODS for o in OUTPUT_UNITS}

# --- the catalogue ------------------------------------------------------------------------------

_R, _O, _I = Knowledge.REGISTER, Knowledge.OBSERVABLE, Knowledge.INSIDER
_SIGNATURE = {  # fixed values: key, output and plausible range of a signature attribute
    "warmteverlies": ("H", (0, 1500)), "thermische_massa": ("C", (0, 150000)),
    "tijdconstante": ("tau", (0, 1000)), "zonnetoetreding": ("Asol", (0, 300)),
    "infiltratie": ("Ainf", (0, 2000)),
}

# The attributes, their kind, who knows them and where they can be looked up.
_BASE = [
    QidSpec("bouwjaar", NUMERIC, _R, "bouwjaar__yr", "construction year", domain=(1000, 2100)),
    QidSpec("oppervlakte", NUMERIC, _R, "oppervlakte__m2", "usable floor area [m²]",
            domain=(1, 2000)),
    QidSpec("energielabel", CATEGORICAL, _R, "energielabel__cat", "energy label",
            normalise=clean.label, domain=clean.ENERGY_LABELS),
    QidSpec("woningtype", CATEGORICAL, _R, "woningtype__cat", "dwelling type",
            normalise=clean.dwelling_type, domain=clean.DWELLING_TYPES),
    QidSpec("postcode6", CATEGORICAL, _R, "postcode6__str", "postcode (6)",
            normalise=clean.postcode),
    QidSpec("postcode4", CATEGORICAL, _R, "postcode4__str", "postcode (4)",
            normalise=clean.postcode4),
    QidSpec("gemeente", CATEGORICAL, _R, "gemeente__cat", "municipality",
            normalise=clean.free_text),
    QidSpec("provincie", CATEGORICAL, _R, "provincie__cat", "province",
            normalise=clean.free_text),
    QidSpec("h3_cel", CATEGORICAL, _R, "h3_cel", "grid cell", normalise=clean.lower_text),
    QidSpec("knmi_station", CATEGORICAL, _R, "knmi_station__cat", "nearest weather station",
            normalise=clean.station),
    QidSpec("daktype", CATEGORICAL, _R, "daktype__cat", "roof type", normalise=clean.roof,
            domain=("schuin", "plat", "plat_meerdere")),
    QidSpec("bouwlagen", NUMERIC, _R, "bouwlagen__0", "number of floors", domain=(1, 5)),
    QidSpec("hoogte", NUMERIC, _R, "hoogte__m", "building height [m]", integer=False,
            domain=(0, 60)),
    QidSpec("aaneengebouwd", CATEGORICAL, _R, "aaneengebouwd__bool", "attached",
            normalise=clean.boolean, domain=("true", "false")),
    QidSpec("uhi", NUMERIC, _R, "uhi__degC", "urban heat island [°C]", integer=False,
            domain=(0, 4)),
    QidSpec("zonnepanelen", CATEGORICAL, _O, None, "solar panels", normalise=clean.free_text),
    QidSpec("glastype", CATEGORICAL, _O, None, "glazing", normalise=clean.free_text),
    QidSpec("buitenunit", CATEGORICAL, _O, None, "heat pump outdoor unit",
            normalise=clean.free_text),
    QidSpec("installatiedatum", NUMERIC, _I, None, "installation date (year)"),
    QidSpec("toestel", CATEGORICAL, _I, None, "appliance make/model", normalise=clean.free_text),
    QidSpec("vermogen", NUMERIC, _I, None, "installed capacity [kW]", integer=False),
    QidSpec("isolatie", CATEGORICAL, _I, None, "insulation", normalise=clean.free_text),
    QidSpec("jaarverbruik", NUMERIC, _I, None, "annual gas/electricity use", integer=False),
]


def _signature_specs():
    """Attributes of the computed signature: every output of nta8800; what differs for the
    register-based methods; for the label-based ones every output with its own column."""
    own = {"": tuple(_SIGNATURE), "mwa": ("warmteverlies", "tijdconstante", "zonnetoetreding",
                                          "infiltratie"),
           "best": ("warmteverlies", "tijdconstante", "zonnetoetreding", "infiltratie"),
           "ep": tuple(_SIGNATURE), "passend": tuple(_SIGNATURE),
           "passend_cbag": ("thermische_massa", "tijdconstante", "infiltratie")}
    for method, keys in own.items():
        for key in keys:
            output, domain = _SIGNATURE[key]
            yield QidSpec(f"{key}_{method}" if method else key, NUMERIC, _R,
                          signature_column(output, method or "nta8800"),
                          f"{output}, {method or 'nta8800'}", integer=False, domain=domain)


CATALOGUE: dict[str, QidSpec] = {s.key: s for s in [*_BASE, *_signature_specs()]}


def signature_qid(method: str, output: str) -> str | None:
    """Catalogue key of one output of one method; a method without its own column for the output
    shares another's."""
    key = next(k for k, (o, _) in _SIGNATURE.items() if o == output)
    if method == "passend_cbag" and output in ("H", "Asol"):
        return f"{key}_passend"
    if method in ("ep", "passend", "passend_cbag"):
        return f"{key}_{method}"
    if method == "nta8800" or output == "C":
        return key
    return f"{key}_{method}" if f"{key}_{method}" in CATALOGUE else None
