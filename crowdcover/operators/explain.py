"""How much does each attribute give away, and who else holds the same measurements?"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import Knowledge, Qid
from ..session import cut
from . import kmap
from .assess import NO_MATCH, active, constraints, reduced, slots_of
from .ordering import median
from .population import Population


def bits_needed(population: Population) -> float:
    return math.log2(max(population.size(), 1))


def information_bits(df: DataFrame, qids: Sequence[Qid], population: Population,
                     scenario: Knowledge = Knowledge.REGISTER, *, record: str = "record_id",
                     unknown_matches: bool = False) -> DataFrame:
    """Bits each attribute gives away: median and maximum over the records that have a value.

    Counted attributes: log2(N / rows matching that attribute alone). Every value of every
    attribute is a class that constrains one attribute only, so one counting job serves all.
    Estimated attributes: minus log2 of how often the value occurs in the dataset."""
    known = active(qids, scenario)
    slots, _ = slots_of(known)
    frame = constraints(reduced(df, known, record), known, record)
    total = max(population.size(), 1)
    cells = frame.select("_w", F.explode(F.array(*[
        F.struct(F.lit(i).alias("nr"), F.col(f"c{i}").alias("c")) for i in range(len(known))]))
        .alias("x")).select("_w", "x.nr", "x.c").where(F.col("c").isNotNull())
    values = cut(cells.groupBy("nr", F.to_json("c").alias("text")).agg(
        F.any_value("c").alias("c"), F.sum("_w").alias("records")))
    key = F.concat_ws("|", F.col("nr").cast("string"), F.col("text"))
    register = [i for i, q in enumerate(known) if q.counted]
    singles = values.where(F.col("nr").isin(register)).select(key.alias("key"), *[
        F.when(F.col("nr") == i, F.col("c")).alias(f"c{i}") for i in register])
    counts = kmap.count(singles, population.rows(), slots, key="key",
                        unknown_matches=unknown_matches) if slots else None
    counted = F.col("nr").isin(register)
    totals = values.groupBy("nr").agg(F.sum("records").alias("_known"))
    out = values.withColumn("key", key).join(totals, "nr")
    out = (out.join(counts, "key", "left") if counts is not None
           else out.withColumn("n", F.lit(None).cast("bigint")))
    bits = F.when(counted, F.log2(F.lit(float(total)) / F.greatest(
        F.coalesce("n", F.lit(0)), F.lit(1)))).otherwise(-F.log2(F.col("records") / F.col("_known")))
    out = out.withColumn("bits", bits)
    mid = median(out, "bits", by=["nr"], weight=F.col("records"), name="bits_mediaan")
    top = out.groupBy("nr").agg(F.max("bits").alias("bits_max"))
    names = F.lit([q.column for q in known])
    return mid.join(top, "nr").select(
        F.get(names, F.col("nr")).alias("kenmerk"), "bits_mediaan", "bits_max",
        (~counted).alias("geschat"))


def remaining_bits(assessed: DataFrame) -> DataFrame:
    """Per record: what is still needed after everything it reveals; unknown without a match."""
    return assessed.withColumn("bits_resterend", F.when(
        F.col("status") != NO_MATCH, F.log2(F.greatest(F.col("k"), F.lit(1.0)))))


# Which party holds the same series, by words in a column name; and columns that
# are no series.
HOLDERS = (
    (r"p1|dsmr|slimme_?meter|smart_?meter|(^|_)e_(consumed|delivered|net|import|export)|"
     r"(^|_)p_(consumed|delivered)|elektr|electric|stroom|(^|_)(v_)?gas|(^|_)g_",
     "grid operator and energy supplier (smart meter)"),
    (r"boiler|ketel|(^|_)cv(_|$)|thermostat|thermostaat|setpoint|(^|_)opentherm",
     "maker of the boiler or thermostat (cloud data)"),
    (r"heat_?pump|warmtepomp|(^|_)wp(_|$)|(^|_)hp(_|$)|compressor|(^|_)cop(_|$)",
     "maker of the heat pump (cloud data)"),
    (r"(^|_)pv(_|$)|solar|zon_?pan|omvormer|inverter",
     "maker of the inverter or monitoring portal of solar panels"),
    (r"(^|_)ev(_|$)|laadpaal|charge|charging|laadsessie", "operator of the charging station"),
    (r"kamstrup|warmtemeter|heat_?meter|(^|_)flow|debiet|aanvoer|retour",
     "supplier or reader of the heat meter"),
)
NO_SERIES = r"(^|_)(heeft|has|is|type|soort)_|__(bool|cat|str)$"


def insider_sources(df: DataFrame, columns: Sequence[str], *, min_numeric: float = 0.8,
                    min_distinct: int = 10) -> DataFrame:
    """Parties for whom published measurement columns are a fingerprint: ``(partij, kolom)``.
    Only columns that are mostly numeric and take many values count."""
    from .detect import plain_name

    chosen = {}
    for c in columns:
        if re.search(NO_SERIES, c.lower()):
            continue
        who = next((w for pattern, w in HOLDERS if re.search(pattern, plain_name(c))), None)
        if who:
            chosen[c] = who
    spark = df.sparkSession
    if not chosen:
        return spark.createDataFrame([], "partij string, kolom string")
    names = list(chosen)
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("nr"), F.col(f"`{c}`").cast("string").try_cast("double").alias("v"))
        for i, c in enumerate(names)])).alias("x")).select("x.*")
    # how often a value occurs, then how many there are: no set of values in any one task
    per_value = values.groupBy("nr", "v").agg(F.count(F.lit(1)).alias("n"))
    profile = per_value.groupBy("nr").agg(
        (F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        F.count("v").alias("distinct"))
    return profile.where((F.col("share") >= min_numeric) & (F.col("distinct") >= min_distinct)
                         ).select(F.get(F.lit([chosen[c] for c in names]), F.col("nr")).alias("partij"),
                                  F.get(F.lit(names), F.col("nr")).alias("kolom"))

