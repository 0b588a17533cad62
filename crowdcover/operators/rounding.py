"""How coarsely must a computable quantity be published? Rounding schemes over the population.

A scheme rounds some columns to a step and publishes others as they are. Rows that then look
alike form a group; the sizes of the groups say how well a row is covered.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bucket
from ..session import cut
from .ordering import running_totals
from .population import Population


def schemes(candidates: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Every combination of candidate steps, most detailed first."""
    names = list(candidates)
    return [dict(zip(names, combo))
            for combo in itertools.product(*(sorted(candidates[n]) for n in names))]


def group_sizes(population: Population, grid: Sequence[Mapping[str, float]],
                exact: Sequence[str] = (), k: int = 11) -> DataFrame:
    """Statistics of the groups, one row per scheme (``schema_nr``), all schemes in one job.

    woningen: rows with every column known; aandeel_te_klein: the share in groups smaller than k;
    uniek: rows alone in their group; groep_mediaan: group size of the median row; groepen;
    bits_onthuld: entropy of the published values; bits_resterend: mean log2 of the group size.
    The two entropies add up to log2 of the rows."""
    columns = list(grid[0])
    population.require(*columns, *exact)
    known = F.lit(True)
    for c in [*columns, *exact]:
        known &= F.col(c).isNotNull()
    # rows that agree on every column stay together in every scheme: count them once first
    base = (population.rows().where(known).groupBy(*columns, *exact)
            .agg(F.count(F.lit(1)).alias("_n")))
    buckets = F.explode(F.array(*[
        F.struct(F.lit(i).alias("schema_nr"),
                 *[bucket(F.col(c), s).alias(f"b{j}") for j, (c, s) in enumerate(g.items())])
        for i, g in enumerate(grid)]))
    groups = (base.select(buckets.alias("_s"), *exact, "_n").select("_s.*", *exact, "_n")
              .groupBy("schema_nr", *[f"b{j}" for j in range(len(columns))], *exact)
              .agg(F.sum("_n").alias("n")))
    # groups of the same size are interchangeable from here on
    sizes = groups.groupBy("schema_nr", "n").agg(F.count(F.lit(1)).alias("groups"))
    sizes = cut(sizes.withColumn("rows", F.col("n") * F.col("groups")))
    total = sizes.groupBy("schema_nr").agg(
        F.sum("rows").alias("woningen"),
        F.sum(F.when(F.col("n") < k, F.col("rows")).otherwise(0)).alias("_small"),
        F.sum(F.when(F.col("n") == 1, F.col("rows")).otherwise(0)).alias("uniek"),
        F.sum("groups").alias("groepen"),
        F.sum(F.col("rows") * F.log2("n")).alias("_nlogn"))
    cum = running_totals(sizes, "n", {"cum": F.col("rows")}, by=["schema_nr"])
    mid = (cum.join(total.select("schema_nr", "woningen"), "schema_nr")
           .where(F.col("cum") >= F.col("woningen") / 2.0)
           .groupBy("schema_nr").agg(F.min("n").cast("double").alias("groep_mediaan")))
    rest = F.col("_nlogn") / F.col("woningen")
    return total.join(mid, "schema_nr").select(
        "schema_nr", *[_step_of(grid, c).alias(f"stap_{c}") for c in columns], "woningen",
        (F.col("_small") / F.col("woningen")).alias("aandeel_te_klein"), "uniek", "groep_mediaan",
        "groepen", (F.log2("woningen") - rest).alias("bits_onthuld"), rest.alias("bits_resterend"))


def _step_of(grid, column: str) -> Column:
    steps = F.lit([float(g[column]) for g in grid])
    return F.get(steps, F.col("schema_nr"))


def scheme_key(steps: Mapping[str, float], exact: Sequence[str] = ()) -> Column:
    """Hash of a row's published values: md5 of the bucket numbers and exact values."""
    parts = [bucket(F.col(c), s).cast("string") for c, s in steps.items()]
    return F.md5(F.concat_ws("|", *parts, *[F.col(c).cast("string") for c in exact]))


def rainbow(population: Population, steps: Mapping[str, float], exact: Sequence[str] = ()
            ) -> DataFrame:
    """Frequency table ``hash -> n``: how many rows share those rounded values, not which."""
    population.require(*steps, *exact)
    known = F.lit(True)
    for c in [*steps, *exact]:
        known &= F.col(c).isNotNull()
    return (population.rows().where(known).groupBy(scheme_key(steps, exact).alias("hash"))
            .agg(F.count(F.lit(1)).alias("n")))


def rainbow_metadata(table: DataFrame, population: Population, steps: Mapping[str, float],
                     exact: Sequence[str] = ()) -> DataFrame:
    """One row on a frequency table: its scheme, scope, total and sources."""
    return table.agg(F.sum("n").alias("woningen"), F.count(F.lit(1)).alias("groepen")).select(
        F.lit(", ".join(f"{c} per {s:g}" for c, s in steps.items())).alias("stappen"),
        F.lit(", ".join(exact)).alias("exact"),
        F.lit(population.scope.description or "all").alias("afbakening"),
        "woningen", "groepen", F.lit(population.snapshot()).alias("bronnen"))


def lookup(records: DataFrame, table: DataFrame, steps: Mapping[str, float],
           exact: Sequence[str] = ()) -> DataFrame:
    """The records with the number of population rows that share their published values."""
    keyed = records.withColumn("hash", scheme_key(steps, exact))
    return keyed.join(table, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
