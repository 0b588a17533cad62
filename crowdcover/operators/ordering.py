"""Running totals, ranks and exact quantiles over a global order, without one big sort task.

The order is cut at approximate quantiles into as many parts as there are shuffle partitions.
A running total is then the total of the parts before plus a window inside the part. The cuts
are constants of the plan, so a task that is run again finds the same parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_le, search
from ..session import cut

#: Equal steps per probability in which :func:`quantiles` looks for the values that matter.
STEPS = 64


def cuts(df: DataFrame, order: str) -> list[float]:
    """Values that cut ``df`` into about equal parts along ``order``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), probs, 2000)).first()[0]
    return sorted(set(found or []))


def running_totals(df: DataFrame, order: str, sums: Mapping[str, Column], *,
                   by: Sequence[str] = (), at: Sequence[float] | None = None,
                   following: str | None = None) -> DataFrame:
    """``df`` with, per name in ``sums``, the total of that expression up to and including the
    row, in the order of a numeric column whose values are unique within ``by``.

    ``df`` is read three times: pass a table that is written or cheap to make. ``at``: where to
    cut, when that is known beforehand. ``following``: a column for the next value of the order
    within ``by``, null for the last."""
    marked = df.withColumns({"_at": F.col(order).cast("double"),
                             **{f"_w_{name}": expr for name, expr in sums.items()}})
    marked = marked.withColumn("_part", count_le(
        cuts(marked, "_at") if at is None else at, F.col("_at")))
    by = list(by)
    parts = marked.groupBy(*by, "_part").agg(
        F.min("_at").alias("_begin"), *[F.sum(f"_w_{name}").alias(f"_t_{name}") for name in sums])
    # at most one row per shuffle partition (and group): a small window
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_part", F.lead("_begin").over(
        Window.partitionBy(*by).orderBy("_part")).alias("_begin"), *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
        for name in sums])
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0)
    out = marked.join(offsets, [*by, "_part"])
    for name in sums:
        out = out.withColumn(name, F.col(f"_o_{name}") + F.sum(f"_w_{name}").over(inside))
    if following:
        in_part = Window.partitionBy(*by, "_part").orderBy("_at")
        out = out.withColumn(following, F.coalesce(F.lead("_at").over(in_part), "_begin"))
    helpers = ["_at", "_part", "_begin"] + [f"{p}_{n}" for n in sums for p in ("_w", "_o")]
    return out.drop(*helpers)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = (),
              weight: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per ``by`` and probability ``p``, with
    the value ``q``. ``weight`` counts a row that many times."""
    by = list(by)
    d = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(0))
    keys = ["_one", *by]
    counts = d.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("_n"))
    counts = cut(counts)
    cum = running_totals(counts, "_v", {"_cum": F.col("_n")}, by=keys)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = cum.join(totals, keys).withColumn("_first", F.col("_cum") - F.col("_n"))

    def covers(rank):
        return (rank >= F.col("_first")) & (rank < F.col("_cum"))

    def at(p):
        return p * (F.col("_total") - 1)

    # a row covers the ranks that lie between it and its neighbours: those from a first to a last one
    marks = sorted({float(p) for p in probs})
    # nearly all cover none: a table of the probabilities below equal steps leaves those out, with a step to
    # spare on either side; the search settles the rest
    steps = STEPS * max(len(marks), 1)
    table = F.lit(np.searchsorted(marks, np.arange(steps + 2) / steps).astype("int32"))
    step = steps / F.greatest(F.col("_total") - 1, F.lit(1))
    ranked = ranked.where(
        F.get(table, F.greatest(F.floor((F.col("_first") - 1) * step).cast("int") - 1, F.lit(0)))
        < F.get(table, F.least(F.floor(F.col("_cum") * step).cast("int") + 2, F.lit(steps + 1))))
    below = search(marks, F.col("_first") - 1, lambda p, v: at(p) <= v)
    upto = search(marks, F.col("_cum"), lambda p, v: at(p) < v)
    rows = ranked.withColumn("_below", below).withColumn("_hits", upto - F.col("_below")).where("_hits > 0")
    rows = rows.withColumn("p", F.explode(F.slice(F.lit(marks), F.col("_below") + 1, F.col("_hits"))))
    lo = F.max(F.when(covers(F.floor(at(F.col("p")))), F.col("_v")))
    hi = F.max(F.when(covers(F.ceil(at(F.col("p")))), F.col("_v")))
    share = F.max(at(F.col("p")) - F.floor(at(F.col("p"))))
    return rows.groupBy(*keys, "p").agg((lo + (hi - lo) * share).alias("q")).drop("_one")


def median(df: DataFrame, value: str, *, by: Sequence[str] = (), weight: Column | None = None,
           name: str = "median") -> DataFrame:
    return quantiles(df, value, [0.5], by=by, weight=weight).drop("p").withColumnRenamed("q", name)
