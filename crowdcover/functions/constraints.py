"""What a published value tells about the true one.

A constraint is a struct ``(lo, hi, vals)``: a closed interval (either bound may be NULL, which
means open) or a sorted set of allowed texts. A NULL struct is the wildcard: anything goes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, plain, to_double

TYPE = "struct<lo:double,hi:double,vals:array<string>>"

# The words and signs a value may be written with.
UNKNOWN = ("nan", "na", "n/a", "none", "null", "onbekend", "unknown", "-", "?")
NUMBER = r"-?\d+(?:[.,]\d+)?"
BETWEEN = ("-", "–", "—", r"\.\.", "t/m", "tot en met", "to")
AT_MOST = ("<=", "≤", "=<", "tot en met", "t/m", r"max\.?", "maximaal")
BELOW = ("<", "voor", "vóór", "before", "tot")
AT_LEAST = (">=", "≥", "=>", "vanaf", "from", r"min\.?", "minimaal")
ABOVE = (">", "na", "after")
OR_MORE = (r"\+", "=>", ">=", "en (?:later|ouder|meer|groter)", "or more")
DECADE = r"(\d{3})0\s*'?s"
SEPARATOR = r"(?i)\s*[|/;]\s*|\s+(?:of|or)\s+"
BLANKS = " \t\r\n\f "


def _words(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _whole(pattern: str) -> str:
    return r"(?iu)^\s*" + pattern + r"\s*$"


EXACT = r"^[+-]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][+-]?\d+)?$"
PATTERNS = {
    "between": _whole(rf"({NUMBER})\s*{_words(BETWEEN)}\s*({NUMBER})"),
    "at_most": _whole(rf"{_words(AT_MOST)}\s*({NUMBER})"),
    "below": _whole(rf"{_words(BELOW)}\s*({NUMBER})"),
    "at_least": _whole(rf"{_words(AT_LEAST)}\s*({NUMBER})"),
    "above": _whole(rf"{_words(ABOVE)}\s*({NUMBER})"),
    "or_more": _whole(rf"({NUMBER})\s*{_words(OR_MORE)}"),
    "decade": _whole(DECADE),
}


def text(value: Column) -> Column:
    """The value without surrounding blanks; NULL when it says "unknown" or nothing."""
    return let(F.btrim(value.cast("string"), F.lit(BLANKS)),
               lambda s: F.when((s != "") & ~F.lower(s).isin(*UNKNOWN), s))


def interval(lo: Column | float | None, hi: Column | float | None) -> Column:
    def bound(b):
        return (b if isinstance(b, Column) else F.lit(b)).cast("double")

    return F.struct(bound(lo).alias("lo"), bound(hi).alias("hi"),
                    F.lit(None).cast("array<string>").alias("vals"))


def one_of(vals: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                    F.array_sort(F.array_distinct(vals)).alias("vals"))


def nothing() -> Column:
    return F.lit(None).cast(TYPE)


def parse_numeric(value: Column, *, integer: bool = True, on_error: Column | None = None) -> Column:
    """A number or a class of numbers. With ``integer`` a strict bound moves one unit inwards.

    An unreadable value (or a class whose bounds are the wrong way round) gives ``on_error``
    when that is given (see :func:`unreadable`), else NULL."""
    unit = 1.0 if integer else 0.0

    def read(s):
        def is_(name):
            return s.rlike(PATTERNS[name])

        def group(name, i=1):
            return to_double(F.regexp_extract(s, PATTERNS[name], i))

        decade = F.regexp_extract(s, PATTERNS["decade"], 1).try_cast("double") * 10
        parsed = (
            F.when(s.rlike(EXACT), let(to_double(s), lambda x: interval(x, x)))
            .when(is_("between"), F.when(group("between", 1) <= group("between", 2),
                                         interval(group("between", 1), group("between", 2))))
            .when(is_("at_most"), interval(None, group("at_most")))
            .when(is_("below"), interval(None, group("below") - unit))
            .when(is_("at_least"), interval(group("at_least"), None))
            .when(is_("above"), interval(group("above") + unit, None))
            .when(is_("or_more"), interval(group("or_more"), None))
            .when(is_("decade"), interval(decade, decade + 9)))
        return F.when(s.isNotNull(), parsed if on_error is None else F.coalesce(parsed, on_error))

    def unwrapped(s):
        inner = F.substr(s, F.lit(2), F.length(s) - 2)
        return F.when(s.rlike(r"^[\[(].+[\])]$"), F.btrim(inner, F.lit(BLANKS))).otherwise(s)

    return let(let(text(value), unwrapped), read)


def parse_categorical(value: Column, *, normalise=None, on_error: Column | None = None) -> Column:
    """One text or several (``A|B``, ``A/B``, ``A of B``), each through ``normalise``; parts
    that cannot be normalised drop out, and nothing left means the wildcard."""
    parts = F.filter(F.split(text(value), SEPARATOR), lambda p: p != "")
    empty = nothing()
    if normalise is not None:
        parts = F.filter(F.transform(parts, normalise), lambda p: p.isNotNull())
    elif on_error is not None:
        empty = on_error
    return let(parts, lambda ps: F.when(F.size(ps) > 0, one_of(ps)).when(ps.isNotNull(), empty))


def unreadable(record: Column, column: str, value: Column) -> Column:
    """An expression that stops the job with the row and column of a bad value."""
    return F.raise_error(F.concat(
        F.lit("row "), F.coalesce(record.cast("string"), F.lit("?")), F.lit(f", column {column}: "),
        F.lit("cannot read as a number or class: "), value.cast("string"))).cast(TYPE)


def render(c: Column) -> Column:
    """The canonical text of a constraint; empty for the wildcard and for an interval that is
    open at both ends, which tells no more."""
    def shown(c):
        ends = F.struct(plain(c["lo"]).alias("lo"), plain(c["hi"]).alias("hi"))
        numeric = let(ends, lambda t: F.when(c["lo"] == c["hi"], t["lo"])
                      .when(c["lo"].isNull() & c["hi"].isNull(), "")
                      .when(c["lo"].isNull(), F.concat(F.lit("<="), t["hi"]))
                      .when(c["hi"].isNull(), F.concat(F.lit(">="), t["lo"]))
                      .otherwise(F.concat(t["lo"], F.lit("-"), t["hi"])))
        return F.when(c["vals"].isNotNull(), F.array_join(c["vals"], "|")).when(
            c.isNotNull(), numeric)

    return F.coalesce(let(c, shown), F.lit(""))


def hull(c: Column) -> Column:
    """Aggregate: the smallest constraint that covers all of a group; one wildcard makes the
    whole group a wildcard, and one open bound leaves that bound open."""
    n = F.count(F.lit(1))
    lo = F.when(F.count(c["lo"]) == n, F.min(c["lo"]))
    hi = F.when(F.count(c["hi"]) == n, F.max(c["hi"]))
    vals = F.flatten(F.collect_set(c["vals"]))
    covered = F.when(F.count(c["vals"]) == n, one_of(vals)).otherwise(interval(lo, hi))
    return F.when((F.count(c) == n) & (n > 0), covered)


def widen(c: Column, tolerance: float) -> Column:
    """A numeric constraint when published values may be off by ``tolerance``."""
    if not tolerance:
        return c
    t = F.lit(float(tolerance))
    return let(c, lambda c: F.when(c["vals"].isNotNull(), c).when(
        c.isNotNull(), interval(c["lo"] - t, c["hi"] + t)))


def width(c: Column) -> Column:
    """Width of a numeric constraint; infinite when a bound is open."""
    return F.coalesce(c["hi"] - c["lo"], F.lit(float("inf")))


def narrowest(a: Column, b: Column) -> Column:
    """Both constraints at once: the intersection of two intervals. Where they contradict each
    other the first stands; :func:`contradicts` tells where."""
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    return (F.when(a.isNull(), b).when(b.isNull(), a)
            .when(lo > hi, a).otherwise(interval(lo, hi)))


def contradicts(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(a["lo"], b["lo"]) > F.least(a["hi"], b["hi"]), F.lit(False))


# The ways a rounded value or a shared class boundary can be read.
NEAREST, DOWN = "dichtstbij", "beneden"
UPPER, LOWER = "boven", "onder"


@dataclass(frozen=True)
class Reading:
    """How published numbers are to be read beyond their face value: rounded to ``step`` (to the
    nearest, or down), and to which class (``boundary``) a boundary that two classes share
    belongs; ``shared`` lists those boundaries."""

    step: float = 0.0
    direction: str = NEAREST
    boundary: str = ""
    shared: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        if self.step < 0:
            raise ValueError(f"a rounding step cannot be negative: {self.step:g}")
        if self.direction not in (NEAREST, DOWN):
            raise ValueError(f"rounding {self.direction!r}: choose {NEAREST} or {DOWN}")
        if self.boundary not in ("", UPPER, LOWER):
            raise ValueError(f"boundary {self.boundary!r}: choose {UPPER} or {LOWER}")

    @classmethod
    def from_config(cls, rounding=None, boundary=None, shared=()) -> Reading | None:
        """From configuration: rounding ``5``, ``"5 beneden"`` or 0; boundary as above, or
        ``beide`` for both classes. None when neither is given."""
        if rounding is None and boundary is None:
            return None
        words = [] if rounding is None else str(rounding).replace(",", ".").split()
        step = float(words[0]) if words else 0.0
        side = "" if boundary in (None, "", "beide") else str(boundary).lower()
        return cls(step, words[1].lower() if len(words) > 1 else NEAREST, side,
                   frozenset(shared) if side else frozenset())

    @property
    def exact(self) -> bool:
        return not self.step and not (self.boundary and self.shared)

    def after_rewriting(self) -> Reading | None:
        """What is left once the column holds other classes than those published."""
        return Reading(self.step, self.direction) if self.step else None

    def describe(self) -> str:
        parts = []
        if self.step:
            how = "to the nearest" if self.direction == NEAREST else "down"
            parts.append(f"rounded to {self.step:g}, {how}")
        if self.boundary and self.shared:
            where = "above" if self.boundary == UPPER else "below"
            parts.append(f"a shared boundary belongs to the class {where}")
        return "; ".join(parts) or "as published"

    def apply(self, c: Column, *, integer: bool) -> Column:
        if self.exact:
            return c
        return let(c, lambda c: F.when(c["vals"].isNotNull(), c).when(
            c.isNotNull(), self._read(c["lo"], c["hi"], integer)))

    def _read(self, lo: Column, hi: Column, integer: bool) -> Column:
        unit = 1.0 if integer else 0.0
        if self.boundary and self.shared:
            inside = lo < hi
            marks = [float(v) for v in sorted(self.shared)]
            if self.boundary == UPPER:
                hi = F.when(inside & hi.isin(marks), hi - unit).otherwise(hi)
            else:
                lo = F.when(inside & lo.isin(marks), lo + unit).otherwise(lo)
        if self.step and self.direction == NEAREST:
            half = self.step / 2
            if integer:
                lo, hi = F.ceil(lo - half), F.ceil(hi + half) - 1
            else:
                lo, hi = lo - half, hi + half
        elif self.step:
            hi = hi + self.step - unit
        return interval(lo, hi)


def satisfies(column: Column, c) -> Column:
    """Predicate: ``column`` satisfies a fixed constraint ``(lo, hi)``, a set of texts, or None
    (anything). An interval without bounds asks only for a known value."""
    if c is None:
        return F.lit(True)
    if isinstance(c, (set, frozenset, list)):
        return column.cast("string").isin(*sorted(str(v) for v in c))
    lo, hi = c
    cond = column.isNotNull() if lo is None and hi is None else None
    for part in ([column >= F.lit(float(lo))] if lo is not None else []) + (
            [column <= F.lit(float(hi))] if hi is not None else []):
        cond = part if cond is None else cond & part
    return cond


def matches(column: Column, c: Column, *, unknown_matches: bool = False) -> Column:
    """Row-wise predicate: the population value satisfies the constraint of the row."""
    inside = (F.coalesce(column.try_cast("double") >= c["lo"], c["lo"].isNull())
              & F.coalesce(column.try_cast("double") <= c["hi"], c["hi"].isNull())
              & column.isNotNull())
    ok = F.when(c["vals"].isNotNull(), F.array_contains(c["vals"], column.cast("string"))
                ).otherwise(inside)
    if unknown_matches:
        ok = column.isNull() | ok
    return c.isNull() | F.coalesce(ok, F.lit(False))
