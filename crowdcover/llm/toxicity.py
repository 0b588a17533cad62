"""Toxic passages: the segments of a text whose words speak most for the toxic class.

1. *Log-odds.* A word's stems are the whole word (lower case, without punctuation) and its beginnings
   of STEMS letters, as one insult comes with many endings. For every word the documents of each class
   that have it are counted, each text once however often it is copied. A Dirichlet prior that follows
   the stem's share of the whole corpus, plus a constant, shrinks the log-odds; a stem whose log-odds
   are many standard deviations from 0 is a scoring stem. A whole word that scores, or that KNOWN
   training documents have, speaks for itself; the others are counted together by their longer
   beginning, and what is still rare by the shorter one, so that a frequent word hides no rare one with
   the same beginning. The model holds the scoring stems, and the known ones that a shorter scoring
   stem would speak for otherwise.
2. *Segments.* A word with a scoring stem scores its log-odds; any other word scores a small negative
   number, the log-odds of seeing no scoring stem. A stem that recurs within a few words scores in
   between, the less the nearer its last occurrence is (REPEAT); farther on it scores in full again,
   so that a passage is judged by itself, whatever the text said before. One linear scan gives all
   maximal segments: those that no extension and no cut within makes better.
3. *Extreme values.* The best segment of n random words is about ln(K n) / lambda, with Gumbel tails.
   lambda solves sum p(s) exp(lambda s) = 1 over the scores of clean words; K fits the clean documents
   of the training rows. A segment is significant if chance would give fewer than MAX_EXPECTED such
   segments in a text of that length. A document's evidence is the sum of lambda S - ln(K n) over its
   significant segments, or that of its best one.
4. *Score.* Evidence becomes a probability by a logistic curve through the training rows, from a
   histogram of bounded size.

Counts, prior and scores cover all documents and whole texts; only the class counts and the two fits
need labels. Counting and scoring read the texts once each and shuffle no text; where there are too
many labels for a broadcast, labelled texts meet their labels by a shuffle.

Defined cases: a null or empty text has no words, no segment, and the score of no evidence;
contradicting labels of a document count as toxic; null labels and null ids are ignored; without any
training row of either class the model has no scoring stem and all scores are equal; repeated rows
are scored alike; other columns pass through, except those with the names of the output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StructField, StructType)

from crowdcover.llm.common import as_bytes, batches, small, unused, written

#: Letters of the beginnings that stand for rare words, longest first.
STEMS = (8, 5)
#: Training documents with a stem from which on no shorter one speaks for it.
KNOWN = 10
#: The prior counts as so many words, spread like the words of the corpus, and so many per stem; the
#: classes share them by their sizes, so it favours neither.
PRIOR_WORDS, PRIOR_EACH = 1000.0, 0.5
#: Standard deviations of the log-odds above which a stem scores, and the least log-odds.
MIN_DEVIATIONS, MIN_LOG_ODDS = 3.0, 3.0
MAX_LOG_ODDS = 8.0
MAX_EXPECTED = 0.05
#: Words since a stem's last occurrence over which a repeat regains 63 % of its score.
REPEAT = 50.0
#: Stems a task counts before it hands them on.
HELD = 300_000
THRESHOLD = 0.3

_EDGES = b".,;:!?\"'()[]{}<>-_*#$%&|/\\"


_LEVELS = ["stem", *[f"stem{k}" for k in STEMS]]


def stem_numbers(words: list[bytes]) -> list[tuple[int, ...]]:
    """The numbers of every word's stems, longest first."""
    import xxhash

    out = []
    for word in words:
        letters = word.strip(_EDGES).decode(errors="replace").lower()
        out.append(tuple(xxhash.xxh64_intdigest(letters[:k].encode(), seed) >> 1
                         for seed, k in enumerate((None, *STEMS))))
    return out


@dataclass(frozen=True)
class Model:
    stems: np.ndarray  # numbers of scoring stems, and of known ones with a shorter that scores
    scores: np.ndarray  # 0: known, scores nothing
    other: float
    scale: float  # lambda
    k: float = 1.0
    slope: float = 1.0
    intercept: float = 0.0


def training_rows(docs: DataFrame, labels: DataFrame, train, doc_id: str, text: str,
                  label: str) -> DataFrame:
    """(doc_id, y): labelled documents to learn from, one of those with equal texts. ``train`` is a
    condition on the column doc_id of the labels."""
    known = written(labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("y"))
                    .where("doc_id IS NOT NULL AND y IS NOT NULL").where(train)
                    .groupBy("doc_id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                        F.xxhash64(F.col(text)).alias("a"), F.length(text).alias("n"))
    return written(texts.join(small(known), "doc_id").groupBy("a", "n", "y").agg(
        F.min("doc_id").alias("doc_id")).select("doc_id", "y").distinct())


def stem_counts(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(stem, one column per beginning, n, toxic, clean): different words of a document that are equal
    but for punctuation, over all documents and over the training rows of either class."""
    def work(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter(), Counter()]  # all, toxic, clean

        def out() -> pa.RecordBatch:
            seen = list(counts[0])
            numbers = np.array(stem_numbers(seen), dtype=np.int64).reshape(-1, len(_LEVELS))
            _, first, at = np.unique(numbers[:, 0], return_index=True, return_inverse=True)
            columns = [np.bincount(at, [c[w] for w in seen], len(first)).astype(np.int64)
                       for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in numbers[first].T] + [pa.array(c) for c in columns],
                [*_LEVELS, "n", "toxic", "clean"])

        for batch in batches_:
            for doc, y in zip(as_bytes(batch[0]), batch[1].to_pylist()):
                words = set(doc.lower().split())
                which = [0] if y is None else [0, 1 if y > 0 else 2]
                for i in which:
                    counts[i].update(words)
                if len(counts[0]) > HELD:
                    yield out()
        yield out()

    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(
        small(rows), "doc_id", "left").select("text", "y")
    return batches(marked, work, ", ".join(f"{c} long" for c in [*_LEVELS, "n", "toxic", "clean"])
                   ).groupBy(_LEVELS).agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


def learn(counts: DataFrame) -> Model:
    """Log-odds and lambda. Only stems that score, or that lie under one that does, come to the
    driver."""
    counts = written(counts)
    n, toxic, clean = counts.agg(F.sum("n"), F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return Model(np.empty(0, np.int64), np.empty(0), -0.01, 1.0)
    share = toxic / (toxic + clean)
    prior = F.lit(PRIOR_EACH) + F.lit(PRIOR_WORDS / n) * F.col("n")
    t, c = F.col("toxic") + prior * share, F.col("clean") + prior * (1 - share)
    left, decided = counts, []
    for k, level in enumerate(_LEVELS):
        shorter = _LEVELS[k + 1:]
        judged = (left.groupBy(level, *shorter).agg(*[F.sum(x).alias(x) for x in ("n", "toxic", "clean")])
                  .where("toxic + clean > 0")
                  .withColumn("odds", F.log(t / share) - F.log(c / (1 - share)))
                  .withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / c))
                  .withColumn("scores", (F.col("toxic") > 0) & (F.col("odds") >= MIN_LOG_ODDS)
                              & (F.col("z") >= MIN_DEVIATIONS))
                  .where(F.col("scores") | (F.col("toxic") + F.col("clean") >= KNOWN)))
        decided.append(written(judged.select(
            F.col(level).alias("at"), *shorter, "scores", "toxic", "clean",
            F.least("odds", F.lit(MAX_LOG_ODDS)).alias("odds"))))
        if shorter:
            left = written(left.join(small(decided[-1].select(F.col("at").alias(level))), level,
                                     "left_anti"))
    parts = []
    for k, found in enumerate(decided):
        parts.append(found.where("scores").select("at", "odds", "toxic", "clean"))
        for level, under in zip(_LEVELS[k + 1:], decided[k + 1:]):
            parts.append(found.where("NOT scores").join(
                under.where("scores").select(F.col("at").alias(level)), level, "left_semi").select(
                    "at", F.lit(0.0).alias("odds"), F.lit(0).alias("toxic"), F.lit(0).alias("clean")))
    rows = reduce(DataFrame.union, parts).distinct().toPandas().sort_values("at")
    scoring = rows[rows["odds"] > 0]
    scores = scoring["odds"].to_numpy(float)
    share_clean = (scoring["clean"].to_numpy(float) + PRIOR_EACH / 10) / clean
    share_toxic = scoring["toxic"].sum() / toxic
    other = float(np.log(max(1e-3, 1 - share_toxic) / max(1e-3, 1 - share_clean.sum())))
    return Model(rows["at"].to_numpy(np.int64), rows["odds"].to_numpy(float), min(other, -0.005),
                 _scale(scores, share_clean, min(other, -0.005)))


def _scale(scores: np.ndarray, shares: np.ndarray, other: float) -> float:
    """lambda, by halving."""
    def excess(x: float) -> float:
        return float((shares * np.exp(x * scores)).sum() + (1 - shares.sum()) * np.exp(x * other)) - 1

    if not len(scores) or (shares * scores).sum() + (1 - shares.sum()) * other >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def maximal_segments(at: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, words ``start`` up to ``end``.

    ``at``: places of the words that score, ``scores``: theirs; all other words score ``other`` < 0.
    One pass with a list of open segments: start, end, the running sum before and behind it, and
    the last segment before with a smaller sum before, which makes the pass linear."""
    done: list[list] = []
    total, last = 0.0, 0
    for place, score in zip(at.tolist(), scores.tolist()):
        total += other * (place - last)
        last = place + 1
        start, before, j = place, total, len(done) - 1
        total += score
        while True:
            while j >= 0 and done[j][2] >= before:
                j = done[j][4]
            if j < 0 or done[j][3] >= total:
                break
            start, before, down = done[j][0], done[j][2], done[j][4]
            del done[j:]
            j = down
        done.append([start, place + 1, before, total, j])
    return [(s, e, behind - before) for s, e, before, behind, _ in done]


def stem_of(numbers: tuple[int, ...], table: dict[int, float]) -> int:
    """The scoring stem that speaks for a word, or -1."""
    at = next((i for i in numbers if i in table), -1)
    return at if table.get(at) else -1


def damped(numbers: np.ndarray, at: np.ndarray, scores: np.ndarray,
           other: float) -> tuple[np.ndarray, np.ndarray]:
    """``at`` and ``scores`` (> ``other``) after repeats are damped by the distance to the last
    occurrence of their number; places that score nothing above 0 any more are plain words."""
    order = np.argsort(numbers, kind="stable")
    again = numbers[order][1:] == numbers[order][:-1]
    gaps = np.full(len(at), np.inf)
    gaps[order[1:][again]] = np.diff(at[order])[again]
    out = other + (scores - other) * -np.expm1(-gaps / REPEAT)
    return at[out > 0], out[out > 0]


def find_passages(docs: DataFrame, model: Model, text: str, out: str = "segments") -> DataFrame:
    """``docs`` with n_tokens and ``out`` (array<struct<start, end, score>>, in words)."""
    docs = docs.drop("n_tokens", out)
    segment = StructType([StructField("start", LongType()), StructField("end", LongType()),
                          StructField("score", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField("n_tokens", LongType()),
                         StructField(out, ArrayType(segment))])
    shared = docs.sparkSession.sparkContext.broadcast((model.stems, model.scores, model.other))

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, scores, other = shared.value
        table = dict(zip(stems.tolist(), scores.tolist()))
        known: dict[bytes, int] = {}  # scoring stem of a word, or -1
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                   ("score", pa.float64())]))
        for batch in rows:
            sizes, found = [], []
            for doc in as_bytes(batch[text]):
                words = doc.lower().split()
                got = list(map(known.get, words))
                if None in got:
                    new = list({w for w, i in zip(words, got) if i is None})
                    fresh = {w: stem_of(i, table) for w, i in zip(new, stem_numbers(new))}
                    got = [fresh[w] if i is None else i for w, i in zip(words, got)]
                    if len(known) < HELD:
                        known.update((w, i) for w, i in fresh.items() if len(w) <= 40)
                numbers = np.array(got, dtype=np.int64)
                at = np.flatnonzero(numbers >= 0)
                at, gains = damped(numbers[at], at, np.array(
                    [table[i] for i in numbers[at].tolist()], dtype=float), other)
                sizes.append(len(words))
                found.append([{"start": s, "end": e, "score": x}
                              for s, e, x in maximal_segments(at, gains, other)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, kind)],
                [*batch.schema.names, "n_tokens", out])

    return batches(docs, work, schema)


def evidence_of(model: Model, segments: str = "segments"):
    """The passages that are significant, and the evidence, as columns."""
    def bits(s):
        return s["score"] * model.scale - F.log(F.greatest(F.col("n_tokens"), F.lit(1)) * model.k)

    # chance gives K n exp(-lambda S) segments as good as this
    passages = F.filter(segments, lambda s: F.exp(-bits(s)) < MAX_EXPECTED)
    best = F.coalesce(F.array_max(F.transform(segments, bits)),
                      -F.log(F.greatest(F.col("n_tokens"), F.lit(1)) * model.k))
    total = F.aggregate(F.transform(passages, bits), F.lit(0.0), lambda a, b: a + b)
    return passages, F.when(F.size(passages) > 0, total).otherwise(best)


def _fit_k(found: DataFrame, model: Model) -> float:
    """K such that the best segments of clean documents are as good as chance expects: ln(K n) is
    the mean of lambda S, less Euler's constant, by which the mean of a Gumbel variable lies higher."""
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    mean = found.where("y <= 0 AND n_tokens > 0").agg(
        F.avg(best * model.scale - F.log("n_tokens"))).first()[0]
    return float(np.exp(mean - np.euler_gamma)) if mean is not None else 1.0


def _fit_curve(histogram: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (evidence, toxic, clean), by Newton steps
    with a small ridge, so that classes that don't overlap still give a finite curve."""
    if not histogram:
        return 1.0, 0.0
    x, toxic, clean = (np.array(c, dtype=float) for c in zip(*histogram))
    n = toxic + clean
    design = np.stack([x / 10, np.ones_like(x)], axis=1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + b @ ridge @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (toxic - n * p) - ridge @ beta
        step = np.linalg.solve((design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, gradient)
        size = 1.0
        while loss(beta + size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0] / 10), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, train, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """``train``: a condition on the labels' doc_id that says which rows may be learned from."""
    rows = training_rows(docs, labels, train, doc_id, text, label)
    model = learn(stem_counts(docs, rows, doc_id, text))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(find_passages(texts.join(small(rows), "doc_id").select("doc_id", "y", "text"),
                                  model, "text").drop("text"))
    model = replace(model, k=_fit_k(found, model))
    _, evidence = evidence_of(model)
    # a histogram of quarters of a unit between -50 and 200: its size is bounded
    bins = (found.withColumn("e", F.round(_bounded(evidence) * 4) / 4).groupBy("e")
            .agg(F.sum((F.col("y") > 0).cast("long")).alias("t"),
                 F.sum((F.col("y") <= 0).cast("long")).alias("c")).collect())
    slope, intercept = _fit_curve([(r["e"], r["t"], r["c"]) for r in bins])
    return replace(model, slope=slope, intercept=intercept)


def _bounded(evidence):
    return F.greatest(F.lit(-50.0), F.least(F.lit(200.0), evidence))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, passages (array<struct<start, end, score>> in words), evidence, score
    and predicted. Nothing is shuffled."""
    docs = docs.drop("n_tokens", "passages", "evidence", "score", "predicted")
    segments, = unused(docs, "segments")
    found = find_passages(docs, model, text, segments)
    passages, evidence = evidence_of(model, segments)
    out = found.withColumns({"passages": passages, "evidence": evidence}).drop(segments)
    chance = 1 / (1 + F.exp(-(_bounded(F.col("evidence")) * model.slope + model.intercept)))
    return out.withColumn("score", chance).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
