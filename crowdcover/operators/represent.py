"""Is the published part still representative, and is the dataset like its population?

Chance is judged by random draws made from hashes: the same in every run, whatever the
partitioning. A draw is a row, so all draws of all columns are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_le, uniform_of
from ..session import cut, keep
from .ordering import quantiles, running_totals
from .population import Population

# Below which difference a shift is negligible, and small.
SMD_SMALL, SMD_NOTABLE = 0.1, 0.2
TVD_SMALL, TVD_NOTABLE = 0.05, 0.10
EMPTY = "(leeg)"
QUANTILES = 1000


def verdict(size: Column, small: float, notable: float) -> Column:
    return F.when(size < small, "verwaarloosbaar").when(size < notable, "klein").otherwise("merkbaar")


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns of which at least 90% of the known values are numbers."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("string")
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("double")).alias(f"x{i}")]
    row = df.agg(*aggs).first()
    return {c for i, c in enumerate(columns) if row[f"n{i}"] and row[f"x{i}"] / row[f"n{i}"] >= 0.9}


#: Hexadecimal digits of a hash, and those of them that number its part: one of 4096.
HASH_DIGITS, PART_DIGITS = 13, 3


def _hash(seed: int, draw: Column, rid: Column) -> Column:
    """The hash of a record in a draw, as a text: texts of one length are in the order of their numbers."""
    return F.substring(F.md5(F.concat_ws(
        "|", F.lit(str(seed)), draw.cast("string"), rid.cast("string"))), 1, HASH_DIGITS)


def omission_limits(ids: DataFrame, left_out: int, draws: int, seed: int) -> list[str]:
    """Per draw the hash up to which records are left out, so that ``left_out`` of them are.

    Hashes are counted in equal parts first; only the part in which the last one falls is
    ranked, which holds one in 4096 of the records of a draw. One number per draw comes back."""
    each = ids.select("_rid", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.withColumn("h", _hash(seed, F.col("draw"), F.col("_rid")))
    each = each.withColumn("part", F.substring("h", 1, PART_DIGITS))
    counts = each.groupBy("draw", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most 4096 rows per draw
    before = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        (F.col("before") < left_out) & (F.col("before") + F.col("n") >= left_out))
    edge = edge.select("draw", "part", (F.lit(left_out) - F.col("before")).alias("rest"))
    order = Window.partitionBy("draw").orderBy("h", "_rid")
    # one row per draw: safe to broadcast
    last = each.join(F.broadcast(edge), ["draw", "part"]).withColumn(
        "rn", F.row_number().over(order)).where("rn = rest")
    found = {r["draw"]: r["h"] for r in last.select("draw", "h").collect()}
    return [found[i] for i in range(draws)]


def shift(df: DataFrame, kept: str, columns: Sequence[str], *, record: str = "record_id",
          draws: int = 200, seed: int = 0) -> DataFrame:
    """Per column how far the kept records (boolean column ``kept``) differ from all: SMD for
    numbers, TVD for categories, a verdict, and ``toeval``: the share of random omissions of as
    many records that shift at least as much.

    A record is read once and tells by itself in which draws it is left out; sums and counts
    over what is left out combine before they shuffle, and what is kept follows by subtraction."""
    columns = list(columns)
    numbers = numeric_columns(df, columns)
    num = [c for c in columns if c in numbers]
    cat = [c for c in columns if c not in numbers]
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kept)).alias("k")).first()
    total, keptn = sizes["n"], sizes["k"]
    draws = draws if 0 < total - keptn < total else 0
    out_of = F.when(F.col(kept), F.array().cast("array<int>")).otherwise(F.array(F.lit(-1)))
    if draws:
        limits = F.lit(omission_limits(df.select(F.col(record).alias("_rid")), total - keptn, draws, seed))
        out_of = F.concat(out_of, F.filter(
            F.sequence(F.lit(0), F.lit(draws - 1)),
            lambda i: _hash(seed, i, F.col(record)) <= F.get(limits, i)))
    every = F.explode(F.lit(list(range(-1, draws)))).alias("draw")
    # one row per column, draw and category: hashes are made once for all columns
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    cells = F.array(*[F.struct(
        F.lit(c).alias("kolom"), (F.lit(None).cast("string") if c in numbers else F.coalesce(t, F.lit(EMPTY))).alias("x"),
        (t.try_cast("double") if c in numbers else F.lit(None).cast("double")).alias("v"))
        for c, t in zip(columns, text)])
    gone = df.select(out_of.alias("_d"), cells.alias("_c")).select("_d", F.explode("_c").alias("c")).select(
        F.explode("_d").alias("draw"), "c.*").groupBy("kolom", "draw", "x").agg(
            F.sum("v").alias("_gs"), F.count("v").alias("_gv"), F.count(F.lit(1)).alias("_gn"))
    gone = cut(gone)
    whole = df.select(F.explode(cells).alias("c")).select("c.*")
    parts = []
    if num:
        parts.append(_smd(whole.where("x is null").select("kolom", F.col("v").alias("x")),
                          gone.where("x is null").select("kolom", "draw", "_gs", F.col("_gv").alias("_gn")), every))
    if cat:
        parts.append(_tvd(whole.where("x is not null").select("kolom", "x"),
                          gone.where("x is not null").select("kolom", "draw", "x", "_gn"), every, total, keptn))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    out = cut(out)                          # one row per column and draw
    seen = out.where("draw = -1").select("kolom", "maat", F.col("size").alias("waarde"))
    drawn = out.where("draw >= 0").select("kolom", F.abs("size").alias("c"))
    likely = drawn.join(seen, "kolom").groupBy("kolom").agg(
        F.avg((F.col("c") >= F.abs("waarde") - 1e-12).cast("double")).alias("toeval"))
    size = F.abs("waarde")
    return seen.join(likely, "kolom", "left").select(
        "kolom", "maat", F.round("waarde", 3).alias("waarde"),
        F.when(F.col("maat") == "SMD", verdict(size, SMD_SMALL, SMD_NOTABLE))
        .otherwise(verdict(size, TVD_SMALL, TVD_NOTABLE)).alias("oordeel"),
        F.round("toeval", 3).alias("toeval"))


def _smd(whole: DataFrame, gone: DataFrame, every: Column) -> DataFrame:
    base = whole.groupBy("kolom").agg(F.sum("x").alias("_s"), F.count("x").alias("_n"),
                                      F.stddev_pop("x").alias("_sd")).select("*", every)
    j = base.join(gone, ["kolom", "draw"], "left").fillna(0, ["_gs", "_gn"])
    left = F.col("_n") - F.col("_gn")
    smd = F.when((left > 0) & (F.col("_sd") > 0), (
        (F.col("_s") - F.col("_gs")) / left - F.col("_s") / F.col("_n")) / F.col("_sd")).otherwise(0.0)
    return j.select("kolom", "draw", F.lit("SMD").alias("maat"), smd.alias("size"))


def _tvd(whole: DataFrame, gone: DataFrame, every: Column, total: int, keptn: int) -> DataFrame:
    base = whole.groupBy("kolom", "x").agg(F.count(F.lit(1)).alias("_n")).select("*", every)
    j = base.join(gone, ["kolom", "draw", "x"], "left").fillna(0, ["_gn"])
    part = (F.col("_n") - F.col("_gn")) / F.lit(float(max(keptn, 1)))
    return j.groupBy("kolom", "draw").agg((F.sum(F.abs(
        F.col("_n") / F.lit(float(total)) - part)) * 0.5).alias("size")).select(
            "kolom", "draw", F.lit("TVD").alias("maat"), "size")


def largest_change(df: DataFrame, kept: str, columns: Sequence[str]) -> DataFrame:
    """Per categorical column the category whose share changes most, before and after."""
    cells = df.select(F.col(kept).alias("_k"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("kolom"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(EMPTY))
                 .alias("categorie")) for c in columns])).alias("v")).select("_k", "v.*")
    per = cells.groupBy("kolom", "categorie").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_k").alias("k"))
    total = per.groupBy("kolom").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    j = per.join(total, "kolom").withColumns({
        "aandeel": F.col("n") / F.col("tn"),
        "aandeel_gehouden": F.col("k") / F.greatest(F.col("tk"), F.lit(1))})
    gap = F.abs(F.col("aandeel_gehouden") - F.col("aandeel"))
    best = j.groupBy("kolom").agg(F.min(F.struct(
        (-F.round(gap, 12)).alias("g"), "categorie", "aandeel", "aandeel_gehouden")).alias("b"))
    return best.select("kolom", "b.categorie", "b.aandeel", "b.aandeel_gehouden")


@dataclass(frozen=True)
class Feature:
    """A population column to compare on; ``source``: the dataset column (same name by default);
    ``edges``: class boundaries for a number."""

    column: str
    source: str | None = None
    edges: tuple[float, ...] = ()
    numeric: bool | None = None


# What is compared when nobody names features.
STANDARD = (Feature("bouwjaar__yr", None, (1945.0, 1965.0, 1975.0, 1992.0, 2006.0)),
            Feature("woningtype__cat"), Feature("energielabel__cat"),
            Feature("oppervlakte__m2", None, (75.0, 100.0, 150.0)))


def class_labels(edges: Sequence[float]) -> list[str]:
    edges = sorted(edges)
    middle = [f"{a:g} tot {b:g}" for a, b in zip(edges, edges[1:])]
    return [f"< {edges[0]:g}", *middle, f"≥ {edges[-1]:g}"]


def _label(x: Column, edges: Sequence[float]) -> Column:
    """The class of a number; unknown is a class of its own."""
    names = F.lit(class_labels(edges))
    return F.coalesce(F.get(names, count_le(edges, x)), F.lit(EMPTY))


def class_table(counts: DataFrame, k: int) -> DataFrame:
    """Shares per class from ``(kenmerk, klasse, pop, ds)``. The dataset share is given only for
    a class with at least ``k`` records; for a smaller one only the direction."""
    total = counts.groupBy("kenmerk").agg(F.sum("pop").alias("tp"), F.sum("ds").alias("td"))
    j = counts.join(total, "kenmerk").where((F.col("pop") > 0) | (F.col("ds") > 0))
    pop = F.col("pop") / F.greatest(F.col("tp"), F.lit(1))
    ds = F.when(F.col("td") > 0, F.col("ds") / F.col("td")).otherwise(0.0)
    way = F.when(ds > pop + 1e-9, "+").when(ds < pop - 1e-9, "−").otherwise("=")
    whole = (F.col("ds") == F.col("td")) & (F.col("td") > 0) & (F.round(pop, 4) < 1 - 1e-9)
    return j.select("kenmerk", "klasse", F.round(pop, 4).alias("populatie"),
                    F.when(F.col("ds") >= k, F.round(ds, 4)).alias("dataset"),
                    way.alias("richting"), whole.alias("alle_records"))


def category_counts(df: DataFrame, population: Population, features: Sequence[Feature]
                    ) -> DataFrame:
    """``(kenmerk, klasse, pop, ds)`` of every categorical feature; unknown is a category."""
    def cells(d, col, n):
        x = F.explode(F.array(*[F.struct(
            F.lit(f.column).alias("kenmerk"),
            (_label(F.col(col(f)).cast("string").try_cast("double"), f.edges) if f.edges
             else F.coalesce(F.col(col(f)).cast("string"), F.lit(EMPTY))).alias("klasse"))
            for f in features]))
        return d.select(x.alias("v")).select("v.*").groupBy("kenmerk", "klasse").agg(
            F.count(F.lit(1)).alias(n))

    pop = cells(population.rows(), lambda f: f.column, "pop")
    ds = cells(df, lambda f: f.source or f.column, "ds")
    return pop.join(ds, ["kenmerk", "klasse"], "full").fillna(0, ["pop", "ds"])


def compare_categories(df: DataFrame, population: Population, features: Sequence[Feature], *,
                       record: str = "record_id", draws: int = 1000, seed: int = 0) -> DataFrame:
    """TVD of dataset and population per categorical feature, a verdict, and ``toeval``: the share
    of random samples of the same size from the population that differ at least as much."""
    counts = cut(category_counts(df, population, features))
    total = counts.groupBy("kenmerk").agg(F.sum("pop").alias("tp"), F.sum("ds").alias("n"))
    j = counts.join(total, "kenmerk")
    p = F.col("pop") / F.greatest(F.col("tp"), F.lit(1))
    tvd = j.groupBy("kenmerk").agg(F.max("n").alias("n"), (F.sum(F.abs(
        F.col("ds") / F.greatest(F.col("n"), F.lit(1)) - p)) * 0.5).alias("waarde"))
    out = tvd
    if draws:
        sampled = category_chance(counts, _records(df, features, record), draws, seed)
        chance = sampled.join(tvd, "kenmerk").groupBy("kenmerk").agg(
            F.avg((F.col("tvd") >= F.col("waarde") - 1e-12).cast("double")).alias("toeval"))
        out = tvd.join(chance, "kenmerk", "left")
    else:
        out = tvd.withColumn("toeval", F.lit(None).cast("double"))
    return out.select("kenmerk", "n", F.lit("TVD").alias("maat"), F.round("waarde", 3).alias("waarde"),
                      verdict(F.col("waarde"), TVD_SMALL, TVD_NOTABLE).alias("oordeel"),
                      F.round("toeval", 3).alias("toeval"))


def _picks(records: DataFrame, draws: int, seed: int) -> DataFrame:
    """A uniform number ``u`` per row of ``records`` (``kenmerk``, ``_rid``) and draw. The texts of a
    record are made before its rows are multiplied."""
    texts = records.select("kenmerk", F.concat_ws("|", F.lit(str(seed)), "kenmerk").alias("_head"), F.coalesce(
        F.concat(F.lit("|"), F.col("_rid").cast("string")), F.lit("")).alias("_tail"))
    each = texts.select("*", F.posexplode(F.lit([f"|{i}" for i in range(draws)])).alias("draw", "_draw"))
    # never null, and the planner must know: its test for nulls would make every hash a second time
    u = F.coalesce(uniform_of(F.concat("_head", "_draw", "_tail")), F.lit(0.0))
    return each.select("kenmerk", "draw", u.alias("u"))


def _slot(x: Column) -> Column:
    """The whole part of a number made from a draw, as a key to join on; never null, as the draw."""
    return F.coalesce(F.floor(x).cast("int"), F.lit(0))


def draw_categories(counts: DataFrame, records: DataFrame, draws: int, seed: int) -> DataFrame:
    """Random samples from the population shares, one number per record (a row of ``records``:
    ``kenmerk``, ``_rid``) and draw: how often each category comes up per draw.

    The categories are laid end to end on [0, 1), in the order of a hash of their name; a uniform
    number falls in one of them. Numbers and categories meet in 1024 equal slots of [0, 1): a
    category lists the slots it touches, so the join is on the slot and a filter settles the ends."""
    total = counts.groupBy("kenmerk").agg(F.sum("pop").alias("tp"))
    name_order = F.conv(F.substring(F.md5("klasse"), 1, 13), 16, 10).cast("double")
    laid = running_totals(counts.where("pop > 0").withColumn("_ord", name_order), "_ord",
                          {"cum": F.col("pop")}, by=["kenmerk"]).join(total, "kenmerk")
    ends = laid.select("kenmerk", "klasse", ((F.col("cum") - F.col("pop")) / F.col("tp"))
                       .alias("a"), (F.col("cum") / F.col("tp")).alias("b"))
    slots = ends.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("a") * 1024).cast("int"),
        F.least(F.floor(F.col("b") * 1024).cast("int"), F.lit(1023)))))
    picks = _picks(records, draws, seed).withColumn("slot", _slot(F.col("u") * 1024))
    hit = (F.col("u") >= F.col("a")) & (F.col("u") < F.col("b"))
    return (picks.join(slots, ["kenmerk", "slot"]).where(hit)
            .groupBy("kenmerk", "draw", "klasse").agg(F.count(F.lit(1)).alias("c")))


def category_chance(counts: DataFrame, records: DataFrame, draws: int, seed: int) -> DataFrame:
    """TVD of every random sample: ``(kenmerk, draw, tvd)``."""
    total = counts.groupBy("kenmerk").agg(F.sum("pop").alias("tp"), F.sum("ds").alias("n"))
    p = counts.join(total, "kenmerk").where("n > 0").select(
        "kenmerk", "klasse", "n", (F.col("pop") / F.greatest(F.col("tp"), F.lit(1))).alias("p"))
    every = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = draw_categories(counts, records, draws, seed)
    j = every.join(drawn, ["kenmerk", "draw", "klasse"], "left").fillna(0, ["c"])
    return j.groupBy("kenmerk", "draw").agg(
        (F.sum(F.abs(F.col("c") / F.col("n") - F.col("p"))) * 0.5).alias("tvd"))


def _records(df: DataFrame, features: Sequence[Feature], record: str) -> DataFrame:
    return df.select(F.explode(F.lit([f.column for f in features])).alias("kenmerk"),
                     F.col(record).alias("_rid"))


def chance_percentile(df: DataFrame, population: Population, features: Sequence[Feature], *,
                      record: str = "record_id", draws: int = 1000, seed: int = 0,
                      q: float = 0.95) -> DataFrame:
    """Per feature the q-quantile of the TVD of random samples of the dataset's size."""
    counts = cut(category_counts(df, population, features))
    tvd = category_chance(counts, _records(df, features, record), draws, seed)
    return quantiles(tvd, "tvd", [q], by=["kenmerk"]).drop("p").withColumnRenamed(
        "q", "tvd_toeval")


def population_numbers(population: Population, columns: Sequence[str], n: int = QUANTILES
                       ) -> tuple[DataFrame, DataFrame]:
    """Moments ``(kenmerk, n, mu, sd)`` and ``n`` interpolated quantiles ``(kenmerk, p, q)``."""
    counts = cut(_value_counts(_number_cells(population.rows(), [(c, c) for c in columns])))
    return _moments(counts), quantiles(counts, "x", _grid(n), by=["kenmerk"], weight=F.col("_n"))


def _value_counts(cells: DataFrame) -> DataFrame:
    """How often every value of ``(kenmerk, x)`` occurs, unknown ones too: ``(kenmerk, x, _n)``."""
    return cells.groupBy("kenmerk", "x").agg(F.count(F.lit(1)).alias("_n"))


def _moments(counts: DataFrame) -> DataFrame:
    """``(kenmerk, n, mu, sd)`` from counted values, which are read twice: the deviations are taken
    from the mean itself, and are zero where all values are equal."""
    n = F.sum(F.when(F.col("x").isNotNull(), F.col("_n")))
    mean = F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.sum(F.col("x") * F.col("_n")) / n)
    base = counts.groupBy("kenmerk").agg(F.coalesce(n, F.lit(0)).alias("n"), mean.alias("mu"))
    # one row per feature: safe to broadcast
    off = F.col("x") - F.col("mu")
    return counts.join(F.broadcast(base), "kenmerk").groupBy("kenmerk").agg(
        F.max("n").alias("n"), F.max("mu").alias("mu"), F.sqrt(F.sum(off * off * F.col("_n")) / n).alias("sd"))


def wasserstein(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(kenmerk, w)``: the exact distance between two sets of numbers ``(kenmerk, x)``: the area between
    their distribution functions, from one running count over the values of both."""
    return _distance(_value_counts(one), _value_counts(other))


def _distance(one: DataFrame, other: DataFrame) -> DataFrame:
    """The distance of :func:`wasserstein` from counted values."""
    values = one.select("kenmerk", "x", F.col("_n").alias("a"), F.lit(0).alias("b")).unionByName(
        other.select("kenmerk", "x", F.lit(0).alias("a"), F.col("_n").alias("b"))).where("x is not null")
    counts = cut(values.groupBy("kenmerk", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    totals = counts.groupBy("kenmerk").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    run = running_totals(counts, "x", {"ca": F.col("a"), "cb": F.col("b")}, by=["kenmerk"], following="volgende")
    gap = F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")) * (F.col("volgende") - F.col("x"))
    return run.join(totals.where("ta > 0 AND tb > 0"), "kenmerk").groupBy("kenmerk").agg(
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("w"))


def _grid(n: int) -> list[float]:
    return [(i + 0.5) / n for i in range(n)]


def _number_cells(df: DataFrame, columns: Sequence[tuple[str, str]], record: str | None = None
                  ) -> DataFrame:
    rid = [F.col(record).alias("_rid")] if record else []

    def number(c):
        # a text has the same number as these types, and is longer in the making
        plain = df.select(c).schema[0].dataType.typeName() in ("byte", "short", "integer", "long", "double")
        return F.col(c).cast("double") if plain else F.col(c).cast("string").try_cast("double")

    return df.select(*rid, F.explode(F.array(*[
        F.struct(F.lit(name).alias("kenmerk"), number(c).alias("x"))
        for name, c in columns])).alias("v")).select(*(["_rid"] if record else []), "v.*")


def compare_numbers(df: DataFrame, population: Population, features: Sequence[Feature], *,
                    record: str = "record_id", draws: int = 1000, seed: int = 0,
                    n_quantiles: int = QUANTILES) -> DataFrame:
    """SMD and Wasserstein distance (in population standard deviations) per numeric feature, and
    the share of random samples from the population whose mean is off at least as much."""
    counts = cut(_value_counts(_number_cells(population.rows(), [(f.column, f.column) for f in features])))
    moments = cut(_moments(counts))
    cells = keep(_number_cells(df, [(f.column, f.source or f.column) for f in features], record))
    mine = cells.groupBy("kenmerk").agg(F.count("x").alias("dn"), F.avg("x").alias("dmu"))
    wass = _distance(counts, _value_counts(cells))
    row = moments.join(mine, "kenmerk").join(wass, "kenmerk", "left")
    usable = (F.col("dn") > 0) & (F.col("sd") > 0)
    row = row.withColumn("smd", F.when(usable, (F.col("dmu") - F.col("mu")) / F.col("sd")))
    row = row.withColumn("wasserstein", F.when(usable, F.col("w") / F.col("sd")))
    if draws:
        pop_q = cut(quantiles(counts, "x", _grid(n_quantiles), by=["kenmerk"], weight=F.col("_n")))
        sampled = _sampled_means(cells.where("x is not null"), pop_q, draws, seed, n_quantiles)
        chance = sampled.join(row.select("kenmerk", "mu", "sd", "smd"), "kenmerk").groupBy(
            "kenmerk").agg(F.avg((F.abs((F.col("m") - F.col("mu")) / F.col("sd"))
                                  >= F.abs("smd") - 1e-12).cast("double")).alias("toeval"))
        row = row.join(chance, "kenmerk", "left")
    else:
        row = row.withColumn("toeval", F.lit(None).cast("double"))
    return row.select("kenmerk", F.col("dn").alias("n"), F.lit("SMD").alias("maat"),
                      F.round("smd", 3).alias("waarde"),
                      F.round("wasserstein", 3).alias("wasserstein"),
                      F.when(usable, verdict(F.abs("smd"), SMD_SMALL, SMD_NOTABLE)).otherwise("")
                      .alias("oordeel"), F.round("toeval", 3).alias("toeval"))


def _sampled_means(cells: DataFrame, pop_q: DataFrame, draws: int, seed: int, n: int) -> DataFrame:
    """Means of random samples, one number per known value of the dataset and draw: uniform
    numbers through the inverse of the population's distribution, linear between its quantiles
    and flat beyond the outermost."""
    at = F.rint(F.col("p") * n - 0.5).cast("int")
    inverse = pop_q.select("kenmerk", at.alias("i"), "q")
    nxt = inverse.select("kenmerk", (F.col("i") - 1).alias("i"), F.col("q").alias("q2"))
    low = inverse.where("i = 0").select("kenmerk", F.lit(-1).alias("i"), "q", F.col("q").alias("q2"))
    table = inverse.join(nxt, ["kenmerk", "i"], "left").unionByName(low)
    picks = _picks(cells, draws, seed).withColumn("pos", F.col("u") * n - 0.5)
    picks = picks.withColumn("i", _slot(F.col("pos")))
    x = F.col("q") + (F.coalesce("q2", "q") - F.col("q")) * (F.col("pos") - F.col("i"))
    # the table has n + 1 rows per feature: safe to broadcast
    return picks.join(F.broadcast(table), ["kenmerk", "i"]).groupBy("kenmerk", "draw").agg(
        F.avg(x).alias("m"))


def compare_linked(linked: DataFrame, population: Population,
                   features: Sequence[Feature] = STANDARD, *, record: str = "record_id",
                   k: int = 11, draws: int = 1000, seed: int = 0, prefix: str = "register_") -> tuple[DataFrame, DataFrame]:
    """The register values of the linked records against the population, on the features the
    population has: the comparison per feature, and the class table."""
    data = linked.where(F.col(f"{prefix}gekoppeld__bool"))
    have = [Feature(f.column, f.source or prefix + f.column, f.edges, f.numeric) for f in features
            if f.column in population.columns and (f.source or prefix + f.column) in data.columns]
    if not have:
        raise ValueError("the population has none of the features to compare on")
    num = [f for f in have if f.edges or f.numeric]
    cat = [f for f in have if not (f.edges or f.numeric)]
    parts = []
    if num:
        parts.append(compare_numbers(data, population, num, record=record, draws=draws,
                                     seed=seed))
    if cat:
        parts.append(compare_categories(data, population, cat, record=record, draws=draws,
                                        seed=seed))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p, allowMissingColumns=True)
    classes = class_table(category_counts(data, population, [
        f for f in have if f.edges or f in cat]), k)
    return table, classes

