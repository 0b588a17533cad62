"""Distances, projections and an own hexagonal grid, as column expressions.

The grid is planar: latitude and longitude are stretched to kilometres around a reference
latitude, and hexagons of equal size cover that plane. Edges grow by sqrt(7) per coarser level,
as in the usual seven-to-one hexagon hierarchies; cells of different levels do not nest exactly,
so the cell of a point is computed at every level from the point itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import let

EARTH_KM = 6371.0088
SERIES_EARTH_KM = 6371.0
# Kilometres per degree around the reference latitude of 52.2 degrees.
REFERENCE_LAT = 52.2
KM_LAT = 110.57
KM_LON = 111.32 * math.cos(math.radians(REFERENCE_LAT))
EDGE_5 = 9.85     # edge in km of a cell of level 5 (about 253 km2)


def edge_km(level: int) -> float:
    return EDGE_5 * 7.0 ** ((5 - level) / 2)


def area_km2(level: int) -> float:
    return 1.5 * math.sqrt(3) * edge_km(level) ** 2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius: float = EARTH_KM) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a flat earth: 111 km per degree of latitude, 68 per degree of longitude."""
    return F.hypot((lat2 - lat1) * 111.0, (lon2 - lon1) * 68.0)


def plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    return lon * F.lit(KM_LON), lat * F.lit(KM_LAT)


# The polynomial from the Dutch national grid (RD, metres) to latitude and longitude.
RD_ORIGIN = (155000.0, 463000.0, 52.15517440, 5.38720621)
RD_LAT = {(0, 1): 3235.65389, (2, 0): -32.58297, (0, 2): -0.24750, (2, 1): -0.84978,
          (0, 3): -0.06550, (2, 2): -0.01709, (1, 0): -0.00738, (4, 0): 0.00530,
          (2, 3): -0.00039, (4, 1): 0.00033, (1, 1): -0.00012}
RD_LON = {(1, 0): 5260.52916, (1, 1): 105.94684, (1, 2): 2.45656, (3, 0): -0.81885,
          (1, 3): 0.05594, (3, 1): -0.05607, (0, 1): 0.01199, (3, 2): -0.00256,
          (1, 4): 0.00128, (0, 2): 0.00022, (2, 0): -0.00022, (5, 0): 0.00026}


def rd_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    x0, y0, lat0, lon0 = RD_ORIGIN
    dx, dy = (x - x0) * 1e-5, (y - y0) * 1e-5

    def power(d, n):
        out = F.lit(1.0)
        for _ in range(n):
            out = out * d
        return out

    def total(terms):
        return sum((F.lit(k) * power(dx, p) * power(dy, q) for (p, q), k in terms.items()),
                   F.lit(0.0))

    return lat0 + total(RD_LAT) / 3600, lon0 + total(RD_LON) / 3600


# --- hexagons -------------------------------------------------------------------------------------

def cell(lat: Column, lon: Column, level: int | Column) -> Column:
    """The cell ``level:q:r`` (axial coordinates) that holds a point; NULL without coordinates."""
    edge = F.lit(edge_km(level)) if isinstance(level, int) else F.lit(EDGE_5) * F.pow(
        F.lit(7.0), (F.lit(5) - level) / 2.0)
    x, y = plane(lat, lon)
    axial = F.struct(((x * math.sqrt(3.0) / 3.0 - y / 3.0) / edge).alias("q"),
                     ((y * 2.0 / 3.0) / edge).alias("r"))
    number = F.lit(level) if isinstance(level, int) else level
    inside = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(inside, let(_rounded(axial), lambda a: F.concat_ws(
        ":", number.cast("string"), a["q"].cast("string"), a["r"].cast("string"))))


def _rounded(axial: Column) -> Column:
    """Axial coordinates of the nearest hexagon: round all three cube coordinates and correct
    the one that moved most."""
    def fix(a):
        q, r, s = a["q"], a["r"], -a["q"] - a["r"]
        rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
        fr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
        return F.struct(fq.cast("bigint").alias("q"), fr.cast("bigint").alias("r"))

    return let(axial, fix)


def parts(c: Column) -> tuple[Column, Column, Column]:
    p = F.split(c, ":")
    return (F.get(p, F.lit(0)).cast("int"), F.get(p, F.lit(1)).cast("bigint"),
            F.get(p, F.lit(2)).cast("bigint"))


def cell_level(c: Column) -> Column:
    return parts(c)[0]


def cell_centre(c: Column) -> Column:
    """The centre of a cell as a struct (lat, lon)."""
    level, q, r = parts(c)
    edge = F.lit(EDGE_5) * F.pow(F.lit(7.0), (F.lit(5) - level) / 2.0)
    x = edge * (q * math.sqrt(3.0) + r * (math.sqrt(3.0) / 2.0))
    y = edge * r * 1.5
    return F.struct((y / KM_LAT).alias("lat"), (x / KM_LON).alias("lon"))


def parent(c: Column, level: int | Column) -> Column:
    """The coarser cell that holds the centre of a cell."""
    return let(cell_centre(c), lambda m: cell(m["lat"], m["lon"], level))


def disk(c: Column, k: int | Column) -> Column:
    """All cells at most ``k`` steps away, the cell itself included."""
    level, q, r = parts(c)
    k = F.lit(k) if isinstance(k, int) else k

    def row(dq):
        lo, hi = F.greatest(-k, -dq - k), F.least(k, -dq + k)
        return F.transform(F.sequence(lo, hi), lambda dr: F.concat_ws(
            ":", level.cast("string"), (q + dq).cast("string"), (r + dr).cast("string")))

    return F.flatten(F.transform(F.sequence(-k, k), row))


def widen_cells(c: Column, tolerance_km: float) -> Column:
    """A set of cells when the true point may lie ``tolerance_km`` away: every cell with its
    neighbours that far out."""
    from . import constraints as con

    def around(one):
        spacing = F.lit(EDGE_5 * math.sqrt(3.0)) * F.pow(
            F.lit(7.0), (F.lit(5) - cell_level(one)) / 2.0)
        steps = F.ceil(F.lit(float(tolerance_km)) / spacing).cast("int")
        return F.when(one.rlike(r"^\d+:-?\d+:-?\d+$"), disk(one, steps)).otherwise(F.array(one))

    return let(c, lambda c: F.when(c["vals"].isNull(), c).otherwise(
        con.one_of(F.flatten(F.transform(c["vals"], around)))))


def with_cells(df: DataFrame, levels, lat: str = "lat__degN", lon: str = "lon__degE",
               name=lambda level: f"h3_r{level}__str") -> DataFrame:
    """The cell of every row at several levels, each from the point itself."""
    return df.withColumns({name(lv): cell(F.col(lat), F.col(lon), lv) for lv in levels})
