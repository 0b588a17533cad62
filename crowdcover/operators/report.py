"""What an assessment gives: candidate lists, publishable records, histograms, comparisons."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import Knowledge, Qid
from ..session import cut
from . import kmap
from .assess import (AT_RISK, NO_MATCH, OK, RESULT, Threshold, active, class_key, constraints,
                     reduced, score_variants, slots_of, text_key)
from .ordering import median
from .population import Population
from .resolve import resolve

K_EDGES = ((0, 10), (11, 30), (31, 100), (101, 300), (301, 1000), (1001, math.inf))


def candidates(assessed: DataFrame, qids: Sequence[Qid], population: Population, *,
               shown: Sequence[str], record: str = "record_id", max_per_record: int | None = None,
               only_at_risk: bool = True, unknown_matches: bool = False) -> DataFrame:
    """The population rows a failing record could be: one row per record and candidate, numbered
    in the order of the ``shown`` columns. Only register attributes select. A record with no
    match gets one row without a candidate; so does one with more than ``max_per_record``, where that
    is given: its ``k_populatie`` tells how many there are.

    The result points at addresses: for the data holder only, never to be published."""
    register = [q for q in qids if q.counted]
    slots, _ = slots_of(register)
    names = [s.name for s in slots]
    rows = assessed.where(F.col("status") == AT_RISK) if only_at_risk else assessed
    rows = cut(rows.select(F.col(record).alias("record"), "status", "k_populatie", "k", "delta",
                           text_key(register).alias("_text"),
                           *dict.fromkeys(q.column for q in register)))
    listed = rows.where(F.col("k_populatie") > 0)
    if max_per_record is not None:
        listed = listed.where(F.col("k_populatie") <= max_per_record)
    texts = constraints(reduced(listed, register, "record"), register, "record")
    texts = cut(texts.withColumn("_key", class_key(names)).select("_text", "_key", *names))
    few = texts.select("_key", *names).dropDuplicates(["_key"])
    shown = list(dict.fromkeys([*shown, *[q.spec.population_column for q in register]]))
    found = kmap.count(few, population.rows(), slots, key="_key", by=shown,
                       unknown_matches=unknown_matches, rows=True)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    # a failing class has few matches, or it would not fail: these windows stay small
    order = Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_last() for c in shown], "_copy")
    found = found.withColumn("kandidaat_nr", F.row_number().over(order)).drop("n", "_copy")
    base = rows.select("record", "status", "k_populatie", "k", "delta", "_text")
    return base.join(texts.select("_text", "_key"), "_text", "left").join(
        found, "_key", "left").drop("_key", "_text")


def publishable(assessed: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """The records that passed, without the columns that must never be published."""
    return assessed.where(F.col("status") == OK).drop(*RESULT, *drop)


def per_record(assessed: DataFrame, qids: Sequence[Qid], record: str = "record_id") -> DataFrame:
    """The internal report: the attributes and the risk of every record."""
    return assessed.select(record, *[q.column for q in qids], *RESULT)


def k_histogram(assessed: DataFrame, norm_k: int) -> DataFrame:
    """Records per class of k; the first class is everything below the norm."""
    lowest = [0, norm_k, *(a for a, _ in K_EDGES[1:] if a > norm_k)]
    tops = [a - 1 for a in lowest[1:]] + [K_EDGES[-1][1]]
    edges = list(zip(lowest, tops))
    # an estimated k may lie between two whole numbers: a class reaches up to the next one
    k = F.coalesce(F.when(F.isnan("k"), 0).otherwise(F.col("k")), F.lit(0))
    number = F.lit(0)
    for i, low in enumerate(lowest[1:], 1):
        number = F.when(k >= low, i).otherwise(number)
    counted = assessed.groupBy(number.alias("klasse_nr")).agg(F.count(F.lit(1)).alias("records"))
    table = assessed.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(edges)],
        "klasse_nr int, k_van double, k_tot double")
    return table.join(counted, "klasse_nr", "left").select(
        "klasse_nr", "k_van", "k_tot", F.coalesce("records", F.lit(0)).alias("records"))


def failure_reasons(assessed: DataFrame, top: int = 5) -> DataFrame:
    """The most common reasons why records fail, with the numbers in them left out."""
    reason = F.explode(F.split("redenen", "; "))
    return (assessed.where(F.col("status") != OK).select(reason.alias("reden"))
            .select(F.regexp_replace("reden", r"=[\d.e+-]+", "=…").alias("reden"))
            .groupBy("reden").agg(F.count(F.lit(1)).alias("records"))
            .orderBy(F.desc("records"), "reden").limit(top))


def scenario_rows(assessed: DataFrame, by: str, *, delta_norm: float = 0.09,
                  edges: Sequence[int] = (11, 100, 1000)) -> DataFrame:
    """One row per scenario or variant: records per class of k (over records with a match), no
    match, delta above the norm, publishable and median k."""
    one = F.col("records") if "records" in assessed.columns else F.lit(1)
    alike = cut(assessed.groupBy(by, "status", "k", "delta").agg(F.sum(one).alias("_w")))
    matched = F.col("status") != NO_MATCH
    k = F.col("k")

    def total(cond):
        return F.sum(F.when(cond, F.col("_w")).otherwise(0))

    bounds = [0, *edges]
    aggs = [F.sum("_w").alias("records")]
    for a, b in zip(bounds, bounds[1:]):
        aggs.append(total(matched & (k >= a) & (k < b)).alias(f"k_{a}_{b}"))
    aggs += [total(matched & (k >= bounds[-1])).alias(f"k_{bounds[-1]}_plus"),
             total(~matched).alias("geen_match"),
             total(matched & (F.col("delta") > delta_norm)).alias("delta_boven_norm"),
             total(F.col("status") == OK).alias("publiceerbaar")]
    mid = median(alike.where(matched), "k", by=[by], weight=F.col("_w"), name="k_mediaan")
    return alike.groupBy(by).agg(*aggs).join(mid, by, "left")


def compare_scenarios(df: DataFrame, scenarios: Mapping[str, tuple[Sequence[Qid], Knowledge]],
                      population: Population, threshold: Threshold = Threshold(), *,
                      record: str = "record_id", unknown_matches: bool = False) -> DataFrame:
    """The same dataset under several attackers or variants, as one job: the risk per ``scenario``
    and distinct combination of texts, with the ``records`` it stands for. What a scenario does
    not use is a wildcard in it."""
    used = {name: resolve(df, active(qids, level), population, record)[0]
            for name, (qids, level) in scenarios.items()}
    # the dataset is read once: what the scenarios distinguish between them is what is left of it
    columns = list(dict.fromkeys(q.column for qids in used.values() for q in qids if q.column in df.columns))
    few = cut(df.groupBy(*columns).agg(F.min(record).alias(record), F.count(F.lit(1)).alias("_rows")))
    variants = [(name, few, qids) for name, qids in used.items()]
    return score_variants(variants, population, threshold, record=record, variant="scenario",
                          unknown_matches=unknown_matches, weight="_rows")


def zone_counts(df: DataFrame, qids: Sequence[Qid], population: Population, zone: str, *,
                record: str = "record_id") -> DataFrame:
    """Per record and zone of the population (a region, station, cell): how many rows match. A
    record that matches nowhere has one row, without a zone and with n = 0."""
    register = [q for q in qids if q.counted]
    slots, _ = slots_of(register)
    names = [s.name for s in slots]
    texts = constraints(reduced(df, register, record), register, record)
    texts = cut(texts.withColumn("_key", class_key(names)).select("_text", "_key", *names))
    classes = texts.select("_key", *names).dropDuplicates(["_key"])
    rows = population.rows().where(F.col(zone).isNotNull())
    counts = kmap.count(classes, rows, slots, key="_key", by=[zone])
    return (df.withColumn("_text", text_key(register)).join(texts.select("_text", "_key"), "_text")
            .join(counts, "_key", "left").drop("_key", "_text")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def candidate_areas(df: DataFrame, qids: Sequence[Qid], population: Population, zone: str, *,
                    group: Sequence[str], size: str, record: str = "record_id") -> DataFrame:
    """For a block of records that share their attributes: in how many zones do at least as many
    population rows match as the block has members (or half as many)? ``df`` holds one row per
    block, with its ``size``."""
    counts = zone_counts(df, qids, population, zone, record=record)
    return counts.groupBy(*group, size).agg(
        F.count(zone).alias("zones"),
        F.count_if(F.col("n") >= F.col(size)).alias("zones_groot_genoeg"),
        F.count_if(F.col("n") >= F.col(size) / 2).alias("zones_halve_grootte"),
        F.sum("n").alias("rijen"))


def chance_too_small(counts: DataFrame, k: int, *, record: str, n: str = "n") -> DataFrame:
    """Expected risk when the zone of a record is unknown: the chance that a matching row lies in
    a zone with fewer than ``k`` matches, sum of n where n < k over sum of n. Without any match it
    is NULL."""
    few = F.sum(F.when(F.col(n) < k, F.col(n)).otherwise(0))
    return counts.groupBy(record).agg(F.try_divide(few, F.sum(n)).alias("kans"))


def shortest_lists(lists: DataFrame, record: str = "record", scenario: str = "scenario"
                   ) -> DataFrame:
    """Of several candidate lists per record, the shortest one, and of equally short ones the
    first scenario. A scenario's list has at most its row limit per record, so this reduces
    per (record, scenario) before the lists meet."""
    per_list = lists.groupBy(record, scenario).agg(F.min("k_populatie").alias("_k"))
    best = per_list.groupBy(record).agg(F.min(F.struct("_k", scenario)).alias("_best"))
    chosen = best.select(record, F.col(f"_best.{scenario}").alias(scenario))
    return lists.join(chosen, [record, scenario])

