"""Which candidate series is nearest to which series: exactly, over all hours.

A series is a row per day with a column per hour, so that it is shuffled once and in a few rows. Entities are
dealt over parts and candidates sent to each; a task holds one part of the entities and one block of the
candidates, both of bounded size, and compares them as lines of hours. Of each part and block only the best
and their equals are left. A shift of an entity is a shift of the candidates, which are far fewer.

The distance is the root mean square of the hours without the largest 2% of the differences.

For series that are compared hour by hour in rows there are lower bounds from means of blocks
(:func:`lower_bounds`) and distances from a histogram (:func:`histograms`). A left-out hour can make the bound of
one block worthless, no more: with every block's square capped at c, leaving out m hours takes at most m * c
away, whatever c is. So the bound is the best over a few caps of (sum of capped squares - m * c).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# When hours are close, and the share of the largest differences that is left out.
CLOSE, TRIM = 0.06, 0.02
#: Differences of daily means, in degrees, at which squares are capped for the bound.
CAPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 16.0)
#: Buckets of a histogram per doubling of the difference.
FINE = 6
#: Days of series that one group of a task holds, of entities and of candidates.
PART_ROWS = 65_536
HOURS = [f"u{h}" for h in range(24)]
#: What rounding may do to a square, as a part of the squares it comes from.
ROUNDING = 1e-9

#: Hours of a block of which means are compared: first all pairs by the day, then what is left by parts.
BLOCKS = (24, 6)

_DAY = 86_400


def day_of(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / _DAY)


def kept_hours(hours: Column, trim: float) -> Column:
    """How many of ``hours`` differences count."""
    return F.greatest(F.floor(hours * (1 - trim)), F.lit(1))


def block_means(rows: DataFrame, keys: Sequence[str], value: str, name: str, hours: int) -> DataFrame:
    """``(*keys, blok, name)``: the mean of a block with all its hours, else null."""
    return rows.groupBy(*keys, F.floor(F.unix_seconds("time") / (hours * 3600)).alias("blok")).agg(
        F.when(F.count(F.lit(1)) == hours, F.avg(value)).alias(name))


def lower_bounds(entities: DataFrame, candidates: DataFrame, of: Sequence[str], among: Sequence[str],
                 trim: float, pairs: DataFrame | None = None, hours: int = BLOCKS[0]) -> DataFrame:
    """``(*of, *among, laag)`` for every entity and candidate with a block of ``hours`` in common: a
    distance that theirs is not below. ``pairs``: only these."""
    mine = block_means(entities, [*of, "uren"], "v", "_v", hours)
    theirs = block_means(candidates, among, "x", "_x", hours)
    if pairs is None:
        met = mine.join(theirs, "blok")
    else:
        met = mine.join(pairs, [c for c in pairs.columns if c in of]).join(theirs, ["blok", *among])
    square = F.coalesce(hours * F.pow(F.col("_v") - F.col("_x"), F.lit(2.0)), F.lit(0.0))
    sums = [F.sum(F.least(square, F.lit(hours * c * c))).alias(f"_c{i}") for i, c in enumerate(CAPS)]
    met = met.groupBy(*of, *among).agg(*sums, F.sum(square).alias("_all"), F.max("uren").alias("uren"))
    kept = kept_hours(F.col("uren"), trim)
    left_out = F.col("uren") - kept
    best = F.greatest(F.lit(0.0), F.when(left_out == 0, F.col("_all")), *[
        F.col(f"_c{i}") - left_out * (hours * c * c) for i, c in enumerate(CAPS)])
    return met.select(*of, *among, F.sqrt(best / kept).alias("laag"))


def differences(pairs: DataFrame, entities: DataFrame, candidates: DataFrame, of: Sequence[str],
                among: Sequence[str]) -> DataFrame:
    """``(*of, *among, d, uren)``: the hours that the entity and the candidate of a pair share."""
    return (pairs.select(*of, *among).join(entities.select(*of, "time", "v", "uren"), list(of))
            .join(candidates.select(*among, "time", "x"), [*among, "time"])
            .select(*of, *among, F.abs(F.col("v") - F.col("x")).alias("d"), "uren"))


def histograms(diffs: DataFrame, keys: Sequence[str], trim: float = TRIM) -> DataFrame:
    """``(*keys, aandeel, gedeeld, laag, hoog, ...)``: the share of close hours, the hours shared, and
    between which bounds the distance lies. The rest tells how many values of which bucket count
    besides the smaller ones."""
    keys, square = list(keys), F.col("d") * F.col("d")
    vak = diffs.groupBy(*keys, _bucket(F.col("d")).alias("_vak")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(square).alias("_s"), F.max("uren").alias("_u"),
        F.count_if(F.col("d") <= CLOSE).alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_vak")      # a row per bucket: some hundred at most
    vak = vak.withColumn("_tot", F.sum("_n").over(order)).withColumn("_mag", kept_hours(F.col("_u"), trim))
    before = F.col("_tot") - F.col("_n")
    edge = F.when((before < F.col("_mag")) & (F.col("_tot") > F.col("_mag")),
                  F.struct("_vak", (F.col("_mag") - before).alias("_rest")))
    out = vak.groupBy(*keys).agg(
        (F.sum("_c") / F.sum("_n")).alias("aandeel"), F.sum("_n").alias("gedeeld"),
        F.sum(F.when(F.col("_tot") <= F.col("_mag"), F.col("_s")).otherwise(0.0)).alias("_s"),
        F.max("_mag").alias("_mag"), F.max(edge).alias("_e"))
    out = out.select(*keys, "aandeel", "gedeeld", "_s", F.least("gedeeld", "_mag").alias("_k"),
                     "_e._vak", F.coalesce("_e._rest", F.lit(0)).alias("_rest"))

    def bound(bucket):
        value = F.pow(F.lit(2.0), bucket / FINE) - 2.0 ** -12
        return F.sqrt((F.col("_s") + F.col("_rest") * F.coalesce(value * value, F.lit(0.0))) / F.col("_k"))

    return out.withColumns({"laag": bound(F.col("_vak")), "hoog": bound(F.col("_vak") + 1)})


def _bucket(d: Column) -> Column:
    return F.floor(F.log2(d + 2.0 ** -12) * FINE).cast("int")


def by_day(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(*keys, dag, u0 ... u23)``: a row per day with the values of its hours, null where there is none.
    Rows of a key and hour are one already."""
    hour = F.pmod(F.floor(F.unix_seconds("time") / 3600), F.lit(24)).cast("int")
    rows = rows.select(*keys, day_of(F.col("time")).alias("dag"), hour.alias("_u"), F.col(value).cast("double").alias("_x"))
    return rows.groupBy(*keys, "dag").agg(*[F.max(F.when(F.col("_u") == h, F.col("_x"))).alias(f"u{h}") for h in range(24)])


def as_hours(days: DataFrame, keys: Sequence[str], name: str = "v") -> DataFrame:
    """``(*keys, time, name)``: the hours of :func:`by_day` that have a value."""
    hour = F.posexplode(F.array(*HOURS)).alias("_u", name)
    time = F.timestamp_seconds(F.col("dag") * _DAY + F.col("_u") * 3600).alias("time")
    return days.select(*keys, "dag", hour).where(F.col(name).isNotNull()).select(*keys, time, name)


def hours_of(days: DataFrame) -> Column:
    """How many hours of a day have a value."""
    return sum((F.col(u).isNotNull().cast("int") for u in HOURS[1:]), F.col(HOURS[0]).isNotNull().cast("int"))


def _lines(rows: pd.DataFrame, keys: list[str], at: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """The keys in order, and per key a line with its hours of the days ``at``."""
    keyed = rows.groupby(keys, dropna=False, sort=True)
    nr, place = keyed.ngroup().to_numpy(), np.searchsorted(at, rows["dag"].to_numpy())
    here = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == rows["dag"].to_numpy())
    lines = np.full((keyed.ngroups, len(at), 24), np.nan)
    lines[nr[here], place[here]] = rows[HOURS].to_numpy("float64")[here]
    names = rows[keys].assign(_nr=nr).drop_duplicates("_nr").sort_values("_nr")[keys].reset_index(drop=True)
    return names, lines.reshape(len(names), -1)


def _distances(v: np.ndarray, x: np.ndarray, hours: np.ndarray, trim: float, least: int) -> np.ndarray:
    """Share of close hours, distance and shared hours (rows) of one line to every line of ``x`` (columns)."""
    known = np.flatnonzero(~np.isnan(v))
    d = np.abs(x[:, known] - v[known])
    met = ~np.isnan(d)
    shared = met.sum(1)
    shared[hours < least] = 0
    close = (d <= CLOSE).sum(1) / np.maximum(shared, 1)
    kept = np.minimum(np.maximum(np.floor(hours * (1 - trim)), 1).astype(int), shared)
    d *= d
    if trim:
        d.sort(axis=1)                                       # what is not known comes last
        total = np.cumsum(d, axis=1)[np.arange(len(x)), np.maximum(kept, 1) - 1] if len(known) else shared * 0.0
    else:
        total = np.where(met, d, 0.0).sum(1)
    with np.errstate(invalid="ignore"):
        return np.stack([close, np.where(kept > 0, np.sqrt(total / np.maximum(kept, 1)), np.nan), shared])


def _groups(group: np.ndarray, score: np.ndarray, best: int):
    """Per group of columns these columns, and the ``best``-th smallest score of each row among them."""
    for g in np.unique(group):
        of_g = np.flatnonzero(group == g)
        nr = min(best, len(of_g)) - 1
        yield of_g, np.partition(score[:, of_g], nr, axis=1)[:, [nr]]


def _possible(v: np.ndarray, x: np.ndarray, uren: np.ndarray, least: int, group: np.ndarray, best: int) -> np.ndarray:
    """Which pairs can be among the best when no hour is left out: squares from products of all lines at once,
    give or take what rounding may do to them."""
    has, there = (~np.isnan(v)).astype(float), (~np.isnan(x)).astype(float)
    v, x = np.nan_to_num(v), np.nan_to_num(x)
    size, shared = (v * v) @ there.T + has @ (x * x).T, np.rint(has @ there.T)
    kept = np.maximum(np.minimum(np.maximum(uren, 1), shared), 1)
    square = np.where((shared > 0) & (uren >= least), (size - 2 * (v @ x.T)) / kept, np.inf)
    slack = ROUNDING * size / kept
    out = np.zeros(square.shape, bool)
    for of_g, last in _groups(group, square + slack, best):
        out[:, of_g] = (square - slack)[:, of_g] <= last
    return out


def _nearest_lines(mine: pd.DataFrame, theirs: pd.DataFrame, of: list[str], among: list[str], each: list[str],
                   frame: list[str], best: int, trim: float, least: int, order: str) -> pd.DataFrame:
    """The best of some candidates for some entities, equals of the last one included."""
    counted = theirs[theirs["_telt"]]
    theirs = theirs[~theirs["_telt"]]
    columns = [*of, *among, "aandeel", "rms", "gedeeld", "uren"]
    if theirs.empty or mine.empty:
        return pd.DataFrame(columns=columns)
    at = np.unique(theirs["dag"].to_numpy())
    names, v = _lines(mine, of, at)
    cands, x = _lines(theirs, among, at)
    if counted.empty:
        uren = mine.assign(_n=mine[HOURS].notna().sum(axis=1)).groupby(of, dropna=False, sort=True)["_n"].sum().to_numpy()
        uren = np.repeat(uren[:, None], len(cands), axis=1)
    else:
        days = np.unique(np.concatenate([at, counted["dag"].to_numpy()]))
        frames, mask = _lines(counted, frame, days)
        # line of its frame per candidate
        which = cands[frame].merge(frames.assign(_f=np.arange(len(frames))), on=frame, how="left")["_f"].to_numpy()
        has = ~np.isnan(_lines(mine, of, days)[1])
        uren = (has.astype("float64") @ (~np.isnan(mask)).T.astype("float64")).round().astype(int)[:, which]
    group = cands.groupby(each, dropna=False, sort=False).ngroup().to_numpy() if each else np.zeros(len(cands), int)
    some = _possible(v, x, uren, least, group, best) if not trim and order == "rms" else np.ones(uren.shape, bool)
    found = np.zeros((len(v), 3, len(x)))
    for i in range(len(v)):
        near = np.flatnonzero(some[i])
        found[i][:, near] = _distances(v[i], x[near], uren[i, near], trim, least)
    score = np.where(found[:, 2] > 0, found[:, 1] if order == "rms" else -found[:, 0], np.inf)
    keep = np.zeros(score.shape, bool)
    for of_g, last in _groups(group, score, best):
        keep[:, of_g] = (score[:, of_g] <= last) & np.isfinite(score[:, of_g])
    e, c = np.nonzero(keep)
    return pd.concat([names.iloc[e].reset_index(drop=True), cands.iloc[c].reset_index(drop=True), pd.DataFrame({
        "aandeel": found[e, 0, c], "rms": found[e, 1, c], "gedeeld": found[e, 2, c].astype("int64"),
        "uren": uren[e, c].astype("int64")})], axis=1)[columns]


def nearest(entities: DataFrame, candidates: DataFrame, *, of: Sequence[str], among: Sequence[str],
            within: Sequence[str], best: int = 2, trim: float = TRIM, counted: DataFrame | None = None,
            least: int = 1, meet: Sequence[str] = (), order: str = "rms") -> DataFrame:
    """``(*of, *among, aandeel, rms, gedeeld, uren)`` of the ``best`` candidates of every ``within`` (``of`` and
    columns of a candidate) and of all that equal the last of these.

    ``entities``: ``(*of, time, v)`` with one row per hour, or written :func:`by_day` of it; ``candidates``:
    ``(*among, time, x)``. ``counted``: some columns of ``among`` and the hours that count for candidates with
    these values, else all hours of an entity do; one with fewer than ``least`` has no row. ``meet``: columns of
    both sides that must be equal. ``order``: "rms", or "aandeel" for the largest share of close hours."""
    of, among, meet = list(of), list(among), list(meet)
    each = [c for c in within if c not in of]
    mine = entities if "dag" in entities.columns else cut(by_day(entities, [*meet, *of], "v"))
    theirs = by_day(candidates, [*meet, *among], "x").withColumn("_telt", F.lit(False))
    frame = [c for c in counted.columns if c != "time"] if counted is not None else []
    if counted is not None:
        hours = by_day(counted.withColumn("_een", F.lit(1.0)), frame, "_een").withColumn("_telt", F.lit(True))
        if meet:
            hours = hours.crossJoin(theirs.select(*meet).distinct())
        theirs = theirs.unionByName(hours, allowMissingColumns=True)
    theirs = cut(theirs)
    cores = mine.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(PART_ROWS, -(-mine.count() // (4 * cores))))
    per = F.count(F.lit(1)) / F.lit(most)
    # a row per value of ``meet``: the parts its entities are dealt over
    sizes = mine.groupBy(*meet).agg(F.greatest(F.ceil(per), F.lit(1)).cast("int").alias("_n"))
    blocks = max(1, -(-(theirs.groupBy(*meet).count().agg(F.max("count")).first()[0] or 0) // PART_ROWS))
    parts = min(10_000, max(2 * cores, (sizes.agg(F.sum("_n")).first()[0] or 1) * blocks))
    keys = [*meet, "_deel", "_blok"]

    def sized(rows):
        return rows.join(F.broadcast(sizes), meet) if meet else rows.crossJoin(F.broadcast(sizes))

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_blok")
    own_block = F.pmod(F.xxhash64(*among), F.lit(blocks)).cast("int")
    left = sized(mine).select(*meet, F.pmod(F.xxhash64(*of), F.col("_n")).cast("int").alias("_deel"), every_block,
                              *of, "dag", *HOURS)
    right = sized(theirs).withColumn("_deel", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(
        "_blok", F.explode(F.when(F.col("_telt"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(own_block))))
    types = {f.name: f.dataType.simpleString() for f in [*mine.schema, *theirs.schema]}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*of, *among]) + ", aandeel double, rms double, gedeeld bigint, uren bigint"

    def scored(a, b):
        return _nearest_lines(a, b, of, among, each, frame, best, trim, least, order)

    found = left.repartition(parts, *keys).groupBy(*keys).cogroup(
        right.repartition(parts, *keys).groupBy(*keys)).applyInPandas(scored, schema)
    if blocks > 1:
        value = F.col("rms") if order == "rms" else -F.col("aandeel")
        found = found.withColumn("_nr", F.rank().over(Window.partitionBy(*within).orderBy(value))).where(
            F.col("_nr") <= best).drop("_nr")
    return found


def close_shares(entities: DataFrame, candidates: DataFrame, of: Sequence[str],
                 among: Sequence[str]) -> DataFrame:
    """``(*of, *among, aandeel)`` for pairs with a close hour: the share of the hours they share
    that are close. Hours meet on the hour and the value, so pairs that are far apart never do;
    the hours shared come from masks of a day, for the pairs found only."""
    of, among = list(of), list(among)
    width = CLOSE + 1e-9
    bucket = lambda c: F.floor(F.col(c) / width)
    mine = entities.withColumn("_b", bucket("v"))
    theirs = candidates.withColumn("_b", F.explode(F.array(*[bucket("x") + k for k in (-1, 0, 1)])))
    close = mine.join(theirs, ["time", "_b"]).where(F.abs(F.col("v") - F.col("x")) <= CLOSE)
    found = cut(close.groupBy(*of, *among).agg(F.count(F.lit(1)).alias("_n")))

    def masks(rows, keys, name):
        hour = F.pmod(F.floor(F.unix_seconds("time") / 3600), F.lit(24)).cast("int")
        return rows.groupBy(*keys, day_of(F.col("time")).alias("dag")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1), hour)).alias(name))

    shared = (found.join(masks(entities, of, "_e"), of).join(masks(candidates, among, "_c"), [*among, "dag"])
              .groupBy(*of, *among).agg(
                  F.max("_n").alias("_n"), F.sum(F.bit_count(F.col("_e").bitwiseAND(F.col("_c")))).alias("_u")))
    return shared.select(*of, *among, (F.col("_n") / F.col("_u")).alias("aandeel"))
