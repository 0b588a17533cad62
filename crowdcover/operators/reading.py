"""How should published numbers be read? Rounding steps and class boundaries, from the values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import Knowledge, Qid
from ..functions import constraints as con
from ..functions.numbers import count_le
from ..session import cut
from .assess import OK, Threshold, active, constraints, score_variants
from .ordering import cuts
from .population import Population

# The rounding steps that are recognised, largest first, and how many distinct
# values are needed before a common step says anything.
STEPS = (100, 50, 25, 10, 5)
MIN_DISTINCT = 3


@dataclass(frozen=True)
class Study:
    """What the values of one numeric column say about how to read them."""

    column: str
    integer: bool
    exact: int = 0
    classes: int = 0
    adjoining: int = 0
    touching: int = 0
    gaps: int = 0
    overlaps: int = 0
    shared: frozenset = field(default_factory=frozenset)
    step: float = 0.0

    @property
    def remarkable(self) -> bool:
        return bool(self.step or self.touching or self.gaps or self.overlaps)

    def proposal(self) -> con.Reading | None:
        return con.Reading(self.step) if self.step else None

    def alternatives(self, chosen: con.Reading | None) -> list[con.Reading]:
        """The other plausible readings."""
        now = chosen or con.Reading()
        out = []
        if self.step:
            out += [con.Reading(self.step, d, now.boundary, now.shared)
                    for d in (con.NEAREST, con.DOWN)]
            if now.step:
                out.append(con.Reading(0.0, con.NEAREST, now.boundary, now.shared))
        if self.touching and self.integer:
            out += [con.Reading(now.step, now.direction, b, self.shared if b else frozenset())
                    for b in ("", con.UPPER, con.LOWER)]
        return [r for r in out if r != now]


def neighbouring_classes(df: DataFrame, qids: Sequence[Qid], record: str) -> DataFrame:
    """The distinct classes per column in order of their bounds, each with the next one and how
    they meet: ``aansluitend`` (join), ``raken`` (share a boundary), ``gaten`` (a gap),
    ``overlap``."""
    distinct = _distinct(df, qids, record)
    classes = distinct.where(F.col("lo").isNull() | F.col("hi").isNull()
                             | (F.col("lo") != F.col("hi")))
    pairs = _with_next(cut(classes))
    unit = F.get(F.lit([1.0 if q.spec.integer else 0.0 for q in qids]), F.col("nr"))
    hi, lo2 = F.col("hi"), F.col("lo_2")
    kind = (F.when(hi.isNull() | lo2.isNull(), "overlap")
            .when((lo2 == hi + unit) & (unit > 0), "aansluitend")
            .when(lo2 == hi, F.when(unit > 0, "raken").otherwise("aansluitend"))
            .when(lo2 > hi, "gaten").otherwise("overlap"))
    return pairs.select("nr", F.get(F.lit([q.column for q in qids]), F.col("nr")).alias("kolom"),
                        "lo", "hi", "lo_2", "hi_2", kind.alias("soort"))


def _with_next(classes: DataFrame) -> DataFrame:
    """Every class with the next one of its column. The order is cut into parts along the lower
    bound; the last class of a part is followed by the first one of the next part that has any."""
    parts = classes.withColumn("_part", F.coalesce(
        count_le(cuts(classes, "lo"), F.col("lo")), F.lit(0)))
    order = Window.partitionBy("nr", "_part").orderBy(F.col("lo").asc_nulls_first(),
                                                      F.col("hi").asc_nulls_last())
    bounds = F.struct("lo", "hi")
    numbered = parts.withColumns({"_next": F.lead(bounds).over(order),
                                  "_nr": F.row_number().over(order)})
    # one row per column and part
    follow = Window.partitionBy("nr").orderBy("_part")
    firsts = numbered.where("_nr = 1").select(
        "nr", "_part", F.lead(bounds).over(follow).alias("_first"))
    out = numbered.join(firsts, ["nr", "_part"]).withColumn("_next", F.coalesce("_next", "_first"))
    return out.where(F.col("_next").isNotNull()).select(
        "nr", "lo", "hi", F.col("_next.lo").alias("lo_2"), F.col("_next.hi").alias("hi_2"))


def _distinct(df: DataFrame, qids: Sequence[Qid], record: str) -> DataFrame:
    """Distinct numeric constraints per column; unreadable values are left out."""
    plain = [q.with_(reading=None, tolerance=0.0) for q in qids]
    frame = constraints(df, plain, record, strict=False)
    cells = frame.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("nr"), F.col(f"c{i}").alias("c")) for i in range(len(qids))]))
        .alias("x")).where(F.col("x.c").isNotNull())
    return cells.select("x.nr", F.col("x.c.lo").alias("lo"), F.col("x.c.hi").alias("hi")).distinct()


def value_steps(df: DataFrame, qids: Sequence[Qid], record: str) -> DataFrame:
    """Per numeric column: how many distinct exact values and classes, and the rounding step:
    the largest that all exact values are multiples of, when there are enough of them, no
    classes, and the tolerance does not already cover the step."""
    d = _distinct(df, qids, record)
    exact = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))
    multiple = {s: F.bool_and(F.when(exact, F.abs(
        F.col("lo") / s - F.rint(F.col("lo") / s)) < 1e-9)) for s in STEPS}
    stats = d.groupBy("nr").agg(F.count_if(exact).alias("exact"),
                                F.count_if(~F.coalesce(exact, F.lit(False))).alias("klassen"),
                                *[m.alias(f"m{s}") for s, m in multiple.items()])
    tolerance = F.get(F.lit([float(q.tolerance) for q in qids]), F.col("nr"))
    step = F.lit(0.0)
    for s in reversed(STEPS):
        step = F.when(F.col(f"m{s}"), float(s)).otherwise(step)
        step = F.when(tolerance >= s / 2, 0.0).otherwise(step)
    enough = (F.col("klassen") == 0) & (F.col("exact") >= MIN_DISTINCT)
    return stats.select("nr", F.get(F.lit([q.column for q in qids]), F.col("nr")).alias("kolom"),
                        "exact", "klassen", F.when(enough, step).otherwise(0.0).alias("stap"))


def study(df: DataFrame, qids: Sequence[Qid], record: str) -> dict[str, Study]:
    """One study per numeric column of the attributes."""
    numeric = [q for q in qids if q.numeric]
    if not numeric:
        return {}
    pairs = neighbouring_classes(df, numeric, record).groupBy("nr").agg(
        *[F.count_if(F.col("soort") == k).alias(k)
          for k in ("aansluitend", "raken", "gaten", "overlap")],
        F.array_sort(F.collect_set(F.when(F.col("soort") == "raken", F.col("hi")))).alias("grenzen"))
    rows = value_steps(df, numeric, record).join(pairs, "nr", "left").collect()   # row per column
    out = {}
    for r in rows:
        q = numeric[r["nr"]]
        out[q.column] = Study(q.column, q.spec.integer, r["exact"], r["klassen"],
                              r["aansluitend"] or 0, r["raken"] or 0, r["gaten"] or 0,
                              r["overlap"] or 0, frozenset(r["grenzen"] or ()), r["stap"])
    return out


def sensitivity(df: DataFrame, qids: Sequence[Qid], population: Population, threshold: Threshold,
                scenario: Knowledge, studies: Mapping[str, Study], *, record: str = "record_id",
                unknown_matches: bool = False) -> DataFrame:
    """How many records could be published under each other plausible reading of one column at a
    time; all readings are assessed in one job."""
    known = active(qids, scenario)
    variants, labels = [], {}
    for q in known:
        found = studies.get(q.column)
        if found is None or not found.remarkable:
            continue
        for i, alt in enumerate(found.alternatives(q.reading)):
            name = f"{q.column}#{i}"
            labels[name] = (q.column, (q.reading or con.Reading()).describe(), alt.describe())
            other = [x.with_(reading=None if alt.exact else alt) if x.column == q.column else x
                     for x in known]
            variants.append((name, df, other))
    spark = df.sparkSession
    schema = "variant string, kolom string, lezing string, alternatief string"
    table = spark.createDataFrame([(n, *t) for n, t in labels.items()], schema)
    if not variants:
        return table.drop("variant").withColumn("publiceerbaar", F.lit(0).cast("bigint"))
    scored = score_variants(variants, population, threshold, scenario, record=record,
                            unknown_matches=unknown_matches)
    passed = scored.groupBy("variant").agg(F.sum(
        F.when(F.col("status") == OK, F.col("records")).otherwise(0)).alias("publiceerbaar"))
    return table.join(passed, "variant").drop("variant")
