"""How filters of a corpus interact: what each order of them removes, at which step, and what for nothing.

A document's failures are a mask, one bit per filter. Documents with one mask fare alike in every
order, so they are counted per part and mask first (one row per part, mask and task before the
shuffle), and the orders are worked out on masks alone, as a min-plus product:

    rank[mask, order] = min over filters f of (fails[mask, f] + position[order, f])

``fails`` is 0 where the mask holds f and infinite elsewhere; ``position`` is the inverse of each
order: the step at which it applies f. The rank is the step that removes the mask's documents; weights
are scattered by it (removed, lost labels), and a filter that fails at a later step than the rank is
redundant there. A part has at most 2^n masks, whatever the size of the corpus.

Whether a text is a repeat is decided on SHA-256 digests, without texts: the smallest id of a digest
comes from one row per digest and task, and rows meet it on (digest, id), so a text that a third of
the corpus shares is no hot key.

Defined cases: a null text is the empty text (it fails A, having no word, and no share rule); a null
id neither repeats a document nor is repeated; rows with the smallest id of their text are all first;
repeated rows count as documents of their own; a null part is the part '' ; a document without a label
counts as neither good nor toxic, of several labels one that says so is enough; an empty table gives
no part and no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import batches, written

#: The five filters, in the order of a mask's bits.
FILTERS = "ABCDE"
#: Limits of the filters: words; percent of distinct words; percent of capitals; symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Orders are listed in full: 7 filters have 5,040.
MOST_FILTERS = 7

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: bytes) -> int:
    """The bits of A to D for a text in UTF-8."""
    words = text.split()  # of bytes: at space and \t to \r, nothing else
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def measured(docs: DataFrame, part: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, part, mask, digest): failures of A to D, and the SHA-256 of the text."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            masks, digests = [], []
            for value in batch.column(2).cast(pa.binary()):
                one = value.as_py() or b""
                masks.append(text_failures(one))
                digests.append(hashlib.sha256(one).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()),
                 pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    return batches(docs.select(F.col(doc_id).cast("long").alias("id"),
                               F.coalesce(part.cast("string"), F.lit("")).alias("part"),
                               F.col(text).alias("text")),
                   work, "id long, part string, mask int, digest binary")


def with_repeats(rows: DataFrame, bit: int = 4) -> DataFrame:
    """``rows`` (id, part, mask, digest) with ``bit`` set where a smaller id has the same digest."""
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").select(
        "digest", "id", F.lit(True).alias("first"))
    known = rows.where("id IS NOT NULL").join(firsts, ["digest", "id"], "left")
    later = F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(1 << bit)))
    return known.select("id", "part", later.alias("mask")).union(
        rows.where("id IS NULL").select("id", "part", "mask"))


def cells(flagged: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask of ``flagged`` (id, part, mask), and
    those that ``labels`` calls good or toxic."""
    known = (labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("g"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("t")))
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return flagged.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), one("g").alias("good"), one("t").alias("toxic"))


def removal_ranks(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """rank[mask, order]: the step, from 1, that removes what has the mask; 0 if none does."""
    n = orders.shape[1]
    position = np.argsort(orders, axis=1) + 1.0  # the inverse permutation, counted from 1
    fails = np.where(masks[:, None] >> np.arange(n) & 1, 0.0, np.inf)
    ranks = np.full((len(masks), len(orders)), np.inf)
    for f in range(n):
        np.minimum(ranks, fails[:, f, None] + position[None, :, f], out=ranks)
    return np.where(np.isinf(ranks), 0, ranks).astype(np.int64)


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, of ``counted`` (part, mask, n, good, toxic)."""
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with letters of their own")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        orders = np.array(list(permutations(range(n))), dtype=np.int64)
        masks = group["mask"].to_numpy(np.int64)
        weights = {c: group[c].to_numpy(np.int64) for c in ("n", "good", "toxic")}
        ranks = removal_ranks(masks, orders)

        def scattered(weight: np.ndarray) -> np.ndarray:
            """[order, rank]: weights added up by the step that removes them; 0: never removed."""
            out = np.zeros((len(orders), n + 1), dtype=np.int64)
            np.add.at(out, (np.arange(len(orders))[None, :], ranks), weight[:, None])
            return out

        removed, good, toxic = (scattered(weights[c]) for c in ("n", "good", "toxic"))
        fails = masks[:, None] >> np.arange(n) & 1
        # of the masks that fail the filter of each step, those an earlier step has removed
        step = np.arange(1, n + 1)
        failing = fails[:, orders]  # [mask, order, step]
        redundant = np.einsum("m,mos->os", weights["n"], failing * (ranks[:, :, None] < step))
        alone = np.array([weights["n"][masks == 1 << f].sum() for f in range(n)], dtype=np.int64)
        gone = removed[:, 1:]
        shapley = np.zeros(n, dtype=np.int64)
        np.add.at(shapley, orders, gone)
        values = (weights["n"].sum() - np.cumsum(gone, axis=1), gone, redundant, alone[orders],
                  good[:, 1:], toxic[:, 1:], shapley[orders])
        return pd.DataFrame({
            "part": group["part"].iloc[0],
            "filter_order": np.repeat(["".join(filters[f] for f in o) for o in orders], n),
            "step": np.tile(step, len(orders)).astype(np.int32)}
            | {c: v.ravel() for c, v in zip(_COUNTS, values)})

    return counted.groupBy("part").applyInPandas(
        work, "part string, filter_order string, step int, "
              + ", ".join(f"{c} long" for c in _COUNTS))


def audit_documents(docs: DataFrame, labels: DataFrame, part: Column, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The audit of the five filters over ``docs``, one part per value of ``part``."""
    rows = written(measured(docs, part, doc_id, text))
    return audit(cells(with_repeats(rows), labels, doc_id))
