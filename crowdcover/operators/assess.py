"""Re-identification risk of every record, measured against the whole population.

k: how many population rows match everything the record reveals (counted on the attributes a
register holds, times an estimated share for the others). delta: which share of those rows is in
the dataset. A record is at risk when k is below the norm, or delta above it when taking part is
itself sensitive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import Knowledge, Qid
from ..functions import constraints as con
from ..functions.numbers import general
from ..session import cut
from . import kmap
from .ordering import median
from .population import Population
from .resolve import resolve

# The statuses of a record, the bounds of p, and when delta is marked.
OK, AT_RISK, NO_MATCH = "ok", "risico", "geen_match"
P_MIN, P_MAX, P_DEFAULT = 0.05, 0.33, 0.09
DELTA_SIGNAL = 0.5


@dataclass(frozen=True)
class Threshold:
    """The highest acceptable chance of re-identification, and of delta when that is judged."""

    p: float = P_DEFAULT
    delta_max: float | None = None

    def __post_init__(self):
        if not P_MIN <= self.p <= P_MAX:
            raise ValueError(f"p must lie in [{P_MIN}, {P_MAX}], got {self.p}")
        if self.delta_max is not None and not 0 < self.delta_max <= 1:
            raise ValueError(f"delta_max must lie in (0, 1], got {self.delta_max}")

    @property
    def k(self) -> int:
        return round(1 / self.p)

    @classmethod
    def norm(cls, p: float, sensitive: bool = False) -> Threshold:
        return cls(p, p if sensitive else None)


def active(qids: Sequence[Qid], scenario: Knowledge) -> list[Qid]:
    """The attributes an attacker of this level knows."""
    return [q for q in qids if q.spec.knowledge <= scenario]


def constraints(df: DataFrame, qids: Sequence[Qid], record: str, *, attacker: bool = True,
                names: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    """``df`` with a constraint column per attribute (``c0``, ``c1``, ...). With ``strict`` an
    unreadable value stops the job and names its row and column; else it gives NULL."""
    for q in qids:
        if q.column not in df.columns:
            raise KeyError(f"column {q.column!r} not in dataset")
    return df.withColumns({
        (names[i] if names else f"c{i}"): q.constraint(
            F.col(q.column), attacker=attacker,
            on_error=con.unreadable(F.col(record), q.column, F.col(q.column)) if strict else None)
        for i, q in enumerate(qids)})


def bad_values(df: DataFrame, qids: Sequence[Qid], record: str) -> DataFrame:
    """Every value that cannot be read: record, column and value."""
    cells = df.select(F.col(record).alias("record"), F.explode(F.array(*[
        F.struct(F.lit(q.column).alias("column"), F.col(q.column).cast("string").alias("value"),
                 (con.text(F.col(q.column)).isNotNull()
                  & q.spec.parse(F.col(q.column)).isNull()).alias("bad"))
        for q in qids if q.numeric])).alias("cell"))
    return cells.where("cell.bad").select("record", "cell.column", "cell.value")


def text_key(qids: Sequence[Qid]) -> Column:
    """The published texts of a record as one key: equal texts, equal fate."""
    texts = [F.col(q.column).cast("string").alias(f"t{i}") for i, q in enumerate(qids)]
    return F.md5(F.to_json(F.struct(*texts))) if texts else F.md5(F.lit("{}"))


def reduced(df: DataFrame, qids: Sequence[Qid], record: str, weight: str | None = None) -> DataFrame:
    """One row per distinct combination of published texts: ``_text``, the number of records
    ``_w``, the lowest record id under its own name, and the texts. ``weight``: the records that a
    row stands for already.

    Reading texts is the costly part per record, and datasets repeat them; so they are read once
    per combination. The aggregation combines before it shuffles: a combination that holds most
    of the records costs one row per task."""
    columns = list(dict.fromkeys(q.column for q in qids))
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"column {c!r} not in dataset")
    return df.groupBy(text_key(qids).alias("_text")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_w"), F.min(record).alias(record),
        *[F.any_value(F.col(c)).alias(c) for c in columns])


def class_key(names: Sequence[str]) -> Column:
    """The equivalence class: equal constraints give equal keys. Numbers in full, so values that
    only look alike when printed stay apart."""
    return F.md5(F.to_json(F.struct(*[F.col(n) for n in names]))) if names else F.md5(F.lit("{}"))


def score(frame: DataFrame, slots: Sequence[kmap.Slot], estimated: Sequence[str],
          population: Population, threshold: Threshold = Threshold(), *, record: str,
          variant: str | None = None, weight: str | None = None, unknown_matches: bool = False,
          strategy: str | None = None) -> DataFrame:
    """Risk per record of ``frame``, which holds a constraint column per slot and per estimated
    attribute. With a ``variant`` column every variant is a dataset of its own; classes that
    occur in several variants are counted once. ``weight``: a row stands for that many records.

    The frame is read twice: pass a table that is written or cheap to make."""
    names = [s.name for s in slots]
    population.require(*[s.column for s in slots])
    by = [variant] if variant else []
    keyed = frame.withColumn("_key", class_key(names))
    groups = keyed.groupBy(*by, "_key").agg(
        F.sum(weight or F.lit(1)).cast("bigint").alias("f_dataset"), F.min(record).alias("klasse"),
        *[F.any_value(n).alias(n) for n in names])
    groups = cut(groups)
    classes = groups.select("_key", *names).dropDuplicates(["_key"]) if variant else groups
    counts = kmap.count(classes.select("_key", *names), population.rows(), slots, key="_key",
                        unknown_matches=unknown_matches, strategy=strategy)
    groups = groups.drop(*names).join(counts, "_key", "left").withColumn(
        "k_populatie", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
    out = keyed.join(groups, [*by, "_key"])
    share = F.lit(1.0)
    for i, e in enumerate(estimated):
        out = _with_share(out, keyed, by, e, f"_share{i}", weight)
        share = share * F.col(f"_share{i}")
    out = out.withColumn("k", F.col("k_populatie") * share)
    return _judged(out, threshold, bool(estimated)).drop(
        "_key", *[f"_share{i}" for i in range(len(estimated))])


def _with_share(out: DataFrame, keyed: DataFrame, by: list[str], name: str, alias: str,
                weight: str | None) -> DataFrame:
    """The estimated share: how often the value occurs among the known values of the dataset.
    An unknown value reveals nothing (share 1)."""
    text = con.render(F.col(name))
    one = F.col(weight) if weight else F.lit(1)
    freq = (keyed.select(*by, text.alias("_val"), one.alias("_w")).where(F.col("_val") != "")
            .groupBy(*by, "_val").agg(F.sum("_w").alias("_n")))
    freq = freq.withColumn("_all", F.lit(0))
    totals = freq.groupBy("_all", *by).agg(F.sum("_n").alias("_total"))
    freq = freq.join(totals, ["_all", *by]).select(
        *by, "_val", (F.col("_n") / F.col("_total")).alias(alias))
    out = out.withColumn("_val", text).join(freq, [*by, "_val"], "left")
    return out.withColumn(alias, F.coalesce(alias, F.lit(1.0))).drop("_val")


def _judged(out: DataFrame, threshold: Threshold, estimated: bool) -> DataFrame:
    f, big_f, k = F.col("f_dataset"), F.col("k_populatie"), F.col("k")
    inf = F.lit(float("inf"))
    delta = F.when(big_f > 0, f / F.greatest(big_f, F.lit(1))).otherwise(inf)
    out = out.withColumns({
        "k_geschat": F.lit(estimated), "delta": delta,
        "risico": F.when(k > 0, F.least(1.0 / F.greatest(k, F.lit(1e-12)), F.lit(1.0))
                         ).otherwise(F.lit(1.0))})
    why = [F.when(k < threshold.k, F.concat(F.lit("k="), general(k, 3),
                                            F.lit(f" < {threshold.k}")))]
    if threshold.delta_max is not None:
        why.append(F.when(F.col("delta") > threshold.delta_max,
                          F.concat(F.lit("δ="), general(F.col("delta"), 3),
                                   F.lit(f" > {threshold.delta_max:g}"))))
    why.append(F.when(f > big_f, F.lit("more records than population rows in this class")))
    reasons = F.concat_ws("; ", *why)
    return out.withColumns({
        "status": F.when(big_f == 0, NO_MATCH).when(reasons != "", AT_RISK).otherwise(OK),
        "redenen": F.when(big_f == 0, "no population row matches this record"
                          ).otherwise(reasons)})


RESULT = ["klasse", "f_dataset", "k_populatie", "k", "k_geschat", "delta", "risico", "status",
          "redenen"]


def slots_of(qids: Sequence[Qid]) -> tuple[list[kmap.Slot], list[str]]:
    """Constraint columns ``c0..`` of the attributes, as counted slots and estimated names."""
    slots = [kmap.Slot(f"c{i}", q.spec.population_column, q.numeric)
             for i, q in enumerate(qids) if q.counted]
    return slots, [f"c{i}" for i, q in enumerate(qids) if not q.counted]


def assess(df: DataFrame, qids: Sequence[Qid], population: Population,
           threshold: Threshold = Threshold(), scenario: Knowledge = Knowledge.REGISTER, *,
           record: str = "record_id", unknown_matches: bool = False,
           strategy: str | None = None) -> DataFrame:
    """``df`` with the risk columns of every record (:data:`RESULT`).

    ``klasse`` is the lowest record id of the equivalence class, its representative."""
    known, _ = resolve(df, active(qids, scenario), population, record)
    slots, estimated = slots_of(known)
    names = [f"c{i}" for i in range(len(known))]
    combos = constraints(reduced(df, known, record), known, record)
    combos = cut(combos.select("_text", "_w", record, *names))
    scored = score(combos, slots, estimated, population, threshold, record=record, weight="_w",
                   unknown_matches=unknown_matches, strategy=strategy)
    return df.withColumn("_text", text_key(known)).join(
        scored.select("_text", *RESULT), "_text").drop("_text")


def score_variants(variants: Sequence[tuple[str, DataFrame, Sequence[Qid]]],
                   population: Population, threshold: Threshold = Threshold(),
                   scenario: Knowledge = Knowledge.INSIDER, *, record: str = "record_id",
                   variant: str = "variant", unknown_matches: bool = False,
                   weight: str | None = None) -> DataFrame:
    """Several datasets (variants of one, or one under several attackers) as one job, so that the
    population is read and reduced once. An attribute that a variant does not use is a wildcard
    in it; one that means another population column in a variant is an attribute of its own.

    One row per variant and distinct combination of texts, which stands for ``records`` records
    (``record`` is the lowest id among them). ``weight``: a row of a variant stands for that many."""
    slots: dict[tuple, kmap.Slot] = {}
    out = None
    for name, df, qids in variants:
        known, _ = resolve(df, active(qids, scenario), population, record)
        frame = constraints(reduced(df, known, record, weight), known, record)
        cols = [F.lit(name).alias(variant), F.col(record), F.col("_w").alias("records")]
        used: set[tuple] = set()
        for i, q in enumerate(known):
            key = (q.spec.population_column, q.numeric) if q.counted else (q.column, None)
            while key in used:      # two columns on one population column: a slot for each
                key = (*key, "again")
            used.add(key)
            slots.setdefault(key, kmap.Slot(f"s{len(slots)}", key[0], bool(key[1])))
            cols.append(F.col(f"c{i}").alias(slots[key].name))
        frame = frame.select(*cols)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    counted = [s for key, s in slots.items() if key[1] is not None]
    estimated = [s.name for key, s in slots.items() if key[1] is None]
    return score(cut(out), counted, estimated, population, threshold, record=record,
                 variant=variant, weight="records", unknown_matches=unknown_matches).drop(
                     *[s.name for s in slots.values()])


def delta_signal() -> Column:
    """Half or more of the look-alikes take part (never for a record without match)."""
    return (F.col("status") != NO_MATCH) & (F.col("delta") >= DELTA_SIGNAL)


def summary(assessed: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status and the k and delta figures; k and delta over records with a match."""
    by = list(by)
    matched = F.col("status") != NO_MATCH
    keys = ["_all", *by]
    # records of one class look the same here: count them once, use that twice
    alike = cut(assessed.withColumn("_all", F.lit(0)).groupBy(
        *keys, "status", "k", "delta", "f_dataset", "k_populatie").agg(F.count(F.lit(1)).alias("_w")))

    def total(cond):
        return F.sum(F.when(cond, F.col("_w")).otherwise(0))

    figures = alike.groupBy(*keys).agg(
        F.sum("_w").alias("records"),
        *[total(F.col("status") == s).alias(s) for s in (OK, AT_RISK, NO_MATCH)],
        F.min(F.when(matched, F.col("k"))).alias("k_min"),
        F.max(F.when(matched, F.col("delta"))).alias("delta_max"),
        total(delta_signal()).alias("delta_signalen"),
        total(F.col("f_dataset") > F.col("k_populatie")).alias("inconsistent"))
    mid = median(alike.where(matched), "k", by=keys, weight=F.col("_w"), name="k_mediaan")
    return figures.join(mid, keys, "left").drop("_all")


def warnings(summary_row: dict, qids: Sequence[Qid], scenario: Knowledge) -> list[str]:
    """What the user should know about an assessment, from its summary."""
    out = []
    if summary_row["inconsistent"]:
        out.append(f"{summary_row['inconsistent']} records fall in a class with more records than "
                   "population rows: the scope is too narrow or the data differ from the register")
    guessed = [q.column for q in active(qids, scenario) if not q.counted]
    if guessed:
        out.append("k is estimated for attributes without a complete register: "
                   + ", ".join(guessed))
    return out
