"""Numbers: rounding, text of a number, hash-seeded draws, position in a list of marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. Without it an expression that uses its input
    many times doubles in size at every level, and so does the code generated for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_double(c: Column) -> Column:
    """A number written with a point or a comma; NULL when it is not a number."""
    return F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def known(c: Column) -> Column:
    """NaN is a value to SQL; here it means unknown, as NULL does."""
    return F.when(F.isnan(c), None).otherwise(c)


def bucket(c: Column, step: float) -> Column:
    """Number of the half-up rounding bucket of width ``step``."""
    return F.floor(c / F.lit(float(step)) + F.lit(0.5)).cast("bigint")


def half_up(c: Column, step: float) -> Column:
    """``c`` rounded to the nearest multiple of ``step``, halves upwards."""
    return F.floor(c / F.lit(float(step)) + F.lit(0.5)) * F.lit(float(step))


def three_digits(c: Column) -> Column:
    """Rounded to three significant digits (halves to even)."""
    scale = F.pow(F.lit(10.0), F.lit(2.0) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.rint(c * scale) / scale)


def general(c: Column, digits: int = 6) -> Column:
    """Text of a number with ``digits`` significant digits, without needless zeros; a power of
    ten only for very small or large ones."""
    def shown(parts):
        text, v = parts["text"], parts["v"]
        size = F.regexp_extract(text, r"e([+-]\d+)$", 1).try_cast("int")   # after rounding
        out = F.when(v == 0, "0")
        for e in range(-4, digits):
            out = out.when(size == e, F.format_string(f"%.{digits - 1 - e}f", v))
        return F.regexp_replace(F.regexp_replace(out.otherwise(text),
                                                 r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")

    shape = F.format_string(f"%.{digits - 1}e", c)
    return F.when(c.isNotNull(), let(F.struct(shape.alias("text"), c.alias("v")), shown))


def plain(c: Column) -> Column:
    """Text of a number: whole numbers without decimals, others with six significant digits."""
    return F.coalesce(let(c, lambda v: F.when(
        (v == F.floor(v)) & (F.abs(v) < 9.0e18), v.cast("bigint").cast("string"))
        .otherwise(general(v))), F.lit(""))


def uniform(*parts: Column | str | int) -> Column:
    """A reproducible draw in [0, 1) from the given parts: the first eight hexadecimal digits
    of their md5. Independent of partitioning and of the engine that computes it."""
    return uniform_of(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                         for p in parts]))


def uniform_of(text: Column) -> Column:
    """The draw of :func:`uniform` from its parts, joined by ``|``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def gaussian(*parts: Column | str | int) -> Column:
    """A reproducible standard normal draw (Box-Muller on two uniform draws)."""
    u = F.greatest(uniform(*parts, "u"), F.lit(1.0e-12))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * np.pi) * uniform(*parts, "v"))


def marks(values) -> Column:
    """A sorted list of numbers as one constant."""
    return F.lit(np.array(sorted(set(float(v) for v in values)), dtype="float64"))


def _steps(n: int) -> Column:
    widths = [1 << i for i in reversed(range(max(n, 1).bit_length()))]
    return F.lit(np.array(widths, dtype="int32"))


def count_le(values, x: Column) -> Column:
    """How many of ``values`` are <= x, by binary search (log n steps per row)."""
    return search(values, x, lambda mark, v: mark <= v)


def count_lt(values, x: Column) -> Column:
    """How many of ``values`` are < x."""
    return search(values, x, lambda mark, v: mark < v)


def search(values, x: Column, before) -> Column:
    """How many of the sorted ``values`` lie before ``x``, as ``before(mark, x)`` tells."""
    values = sorted(set(float(v) for v in values))
    if not values:
        return F.when(x.isNotNull(), F.lit(0))
    if len(values) <= 8:
        return sum((before(F.lit(v), x).cast("int") for v in values[1:]),
                   before(F.lit(values[0]), x).cast("int"))
    arr = marks(values)
    found = F.aggregate(
        _steps(len(values)), F.lit(0),
        lambda at, w: F.when(before(F.get(arr, at + w - 1), x), at + w).otherwise(at))
    return F.when(x.isNotNull(), found)
