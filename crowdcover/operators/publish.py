"""Publishing a computed baseline: round it, assess it, and compare rounding plans."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import CATALOGUE, Knowledge, Qid, output_column, signature_qid
from ..functions.numbers import half_up
from ..session import cut
from . import signature
from .assess import NO_MATCH, OK, Threshold, score_variants
from .link import link
from .ordering import median
from .population import Population


def published_column(output: str) -> str:
    return f"adres_{output_column(output)}"


@dataclass(frozen=True)
class Plan:
    """Which baseline to publish, and the rounding step per output."""

    method: str = "passend"
    steps: Mapping[str, float] = field(default_factory=lambda: {"H": 50.0, "C": 5000.0})

    def describe(self) -> str:
        return f"signature ({self.method}): " + ", ".join(
            f"{o} per {s:g}" for o, s in self.steps.items())


def baseline_values(df: DataFrame, population: Population, method: str, outputs: Sequence[str],
                    references: DataFrame | None = None, *, record: str = "record_id",
                    **key) -> DataFrame:
    """``df`` with the unrounded baseline of the linked dwelling (``_v_H`` ...); NULL when it is
    not linked or not single-family."""
    own = signature.compute(population.df, method, references, prefix="_sig_")
    names = [f"_sig_{output_column(o)}" for o in outputs]
    linked = link(df, Population(own, population.scope), record=record, columns=names,
                  prefix="_l", **key)
    return linked.select(*df.columns, *[F.col(f"_l{n}").alias(f"_v_{o}")
                                        for o, n in zip(outputs, names)])


def apply_plan(values: DataFrame, plan: Plan) -> tuple[DataFrame, list[Qid]]:
    """The rounded baseline as published columns, and the attributes that describe them: their
    tolerance is half a step."""
    qids = []
    out = values
    for o, step in plan.steps.items():
        out = out.withColumn(published_column(o), half_up(F.col(f"_v_{o}"), step))
        key = signature_qid(plan.method, o)
        if key is not None:
            qids.append(Qid(published_column(o), CATALOGUE[key], tolerance=float(step) / 2))
    return out, qids


def add_baseline(df: DataFrame, population: Population, plan: Plan,
                 references: DataFrame | None = None, *, record: str = "record_id", **key
                 ) -> tuple[DataFrame, list[Qid], list[str]]:
    """The dataset with the rounded baseline, its attributes, and the columns never to publish."""
    values = baseline_values(df, population, plan.method, list(plan.steps), references,
                             record=record, **key)
    out, qids = apply_plan(values, plan)
    return out.drop(*[f"_v_{o}" for o in plan.steps]), qids, [c for c in key.values() if c]


def explore(df: DataFrame, population: Population, method: str,
            candidates: Mapping[str, Sequence[float]], threshold: Threshold,
            other_qids: Sequence[Qid] = (), scenario: Knowledge = Knowledge.REGISTER,
            references: DataFrame | None = None, *, record: str = "record_id",
            unknown_matches: bool = False, **key) -> DataFrame:
    """Every combination of rounding steps: how many records could be published, and how precise
    the baseline then is. All combinations are assessed in one job."""
    names = list(candidates)
    # every plan rounds the same values
    values = cut(baseline_values(df, population, method, names, references, record=record, **key))
    plans = [Plan(method, dict(zip(names, combo)))
             for combo in itertools.product(*(sorted(candidates[n]) for n in names))]
    variants = []
    for i, plan in enumerate(plans):
        rounded, qids = apply_plan(values, plan)
        variants.append((str(i), rounded, [*other_qids, *qids]))
    scored = score_variants(variants, population, threshold, scenario, record=record,
                            unknown_matches=unknown_matches)
    alike = cut(scored.groupBy("variant", "status", "k").agg(F.sum("records").alias("_w")))
    passed = alike.groupBy("variant").agg(F.sum("_w").alias("n"), F.sum(
        F.when(F.col("status") == OK, F.col("_w")).otherwise(0)).alias("publiceerbaar"))
    mid = median(alike.where(F.col("status") != NO_MATCH), "k", by=["variant"],
                 weight=F.col("_w"), name="k_mediaan")
    inverse = values.agg(*[F.avg(F.when(F.abs(f"_v_{o}") > 0, 1.0 / F.abs(f"_v_{o}"))).alias(o)
                           for o in names]).first()
    rows = []
    for i, plan in enumerate(plans):
        lost = [100 * s / math.sqrt(12) * inverse[o] if inverse[o] is not None else None
                for o, s in plan.steps.items()]
        seen = [x for x in lost if x is not None]
        rows.append((str(i), *[float(plan.steps[n]) for n in names],
                     float(sum(seen) / len(seen)) if seen else 0.0, *lost))
    schema = "variant string, " + ", ".join(f"`stap_{n}` double" for n in names) + \
        ", `precisieverlies_pct` double, " + ", ".join(f"`precisieverlies_{n}_pct` double" for n in names)
    out = df.sparkSession.createDataFrame(rows, schema).join(passed, "variant").join(
        mid, "variant", "left")
    pct = F.round(100 * F.col("publiceerbaar") / F.col("n"), 1)
    lost = [c for c in out.columns if c.startswith("precisieverlies")]
    return out.select(*[f"stap_{n}" for n in names], "publiceerbaar",
                      pct.alias("publiceerbaar_pct"),
                      (F.col("n") - F.col("publiceerbaar")).alias("niet_publiceren"), "k_mediaan",
                      *[F.round(c, 1).alias(c) for c in lost]).orderBy(
                          F.desc("publiceerbaar_pct"), "precisieverlies_pct",
                          *[f"stap_{n}" for n in names])
