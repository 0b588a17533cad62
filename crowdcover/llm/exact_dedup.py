"""Exact duplicates, by a minimal perfect hash over the digests that are known already.

The corpus so far is *history*: its distinct digests, each with a winner (the largest id) and a count.
History is kept as an index of buckets. A bucket holds a few thousand digests that agree in their
first bytes: the bits of a minimal perfect hash, and per slot the full digest, the winner's locator
and the count. New documents are reduced to one row per digest and task, sent to the bucket of their
digest, and looked up there; there are as many buckets as the larger of the two sides needs; the slot's 32 bytes are compared, as a hash of an unknown digest may
also point to a slot. Members update their slot; the others are grouped among themselves.

Digests are spread evenly over buckets, and a text that a third of all documents share costs each
task one row, so no bucket is hot. Documents meet their winners by digest at the end; there a common
text is a join key with many rows against one, which adaptive execution splits.

Defined cases: a null text is the empty text; equal ids are documents of their own with the same
locator; a null id is smaller than any other; empty tables on either side work; other columns pass
through, except those with the names of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import batches, unused, written
from crowdcover.llm.perfect_hash import PerfectHash, keys_of

#: Digests in a bucket of the index, on average.
BUCKET = 4096

_INDEX = ("bucket long, sizes array<int>, bits array<binary>, digests binary, winners binary, "
          "counts binary")
#: Stands for a null id.
_NONE = -(1 << 63)


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def bucket_of(digest: Column, buckets: int) -> Column:
    first = F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long")
    return F.pmod(first, F.lit(buckets))


def _ids(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_NONE))


def reduced(docs: DataFrame, doc_id: str, digest: str) -> DataFrame:
    """(digest, top, n): one row per digest and task, without a shuffle."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()),
                 pa.array([s[0] for s in seen.values()], pa.int64()),
                 pa.array([s[1] for s in seen.values()], pa.int64())], ["digest", "top", "n"])
            seen.clear()
            return batch

        for batch in rows:
            for key, d in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                slot = seen.setdefault(d, [key, 0])
                slot[0] = max(slot[0], key)
                slot[1] += 1
            if len(seen) > 100_000:  # what is left of a digest meets at its bucket
                yield out()
        yield out()

    return batches(docs.select(_ids(doc_id), F.col(digest)), work, "digest binary, top long, n long")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index of ``history`` (digest, top, n), where a digest may have several rows."""
    def build(group: pd.DataFrame) -> pd.DataFrame:
        one = group.groupby("digest", sort=True).agg(top=("top", "max"), n=("n", "sum"))
        digests = one.index.tolist()
        keys = keys_of(digests)
        found = PerfectHash.build(keys)
        order = np.empty(len(digests), dtype=np.int64)
        order[found.find(keys)] = np.arange(len(digests))  # slot -> row
        packed = found.packed()
        return pd.DataFrame({
            "bucket": [group["bucket"].iloc[0]], "sizes": [[n for n, _ in packed]],
            "bits": [[b for _, b in packed]], "digests": [b"".join(digests[i] for i in order)],
            "winners": [one["top"].to_numpy(np.int64)[order].tobytes()],
            "counts": [one["n"].to_numpy(np.int64)[order].tobytes()]})

    return (history.withColumn("bucket", bucket_of(F.col("digest"), buckets))
            .groupBy("bucket").applyInPandas(build, _INDEX))


def look_up(index: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """(digest, top, n, member): the slots of ``index`` after ``new`` (digest, top, n) has been looked
    up in them, and the rows of ``new`` that are no members."""
    def probe(slots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(slots):
            found = PerfectHash.unpacked(list(zip(slots["sizes"].iloc[0].tolist(),
                                                  slots["bits"].iloc[0])))
            digests = np.frombuffer(slots["digests"].iloc[0], dtype="V32")
            winners = np.frombuffer(slots["winners"].iloc[0], dtype=np.int64).copy()
            counts = np.frombuffer(slots["counts"].iloc[0], dtype=np.int64).copy()
            asked = rows["digest"].tolist()
            at = found.find(keys_of(asked))
            hit = (at >= 0) & (digests[at] == np.array(asked, dtype="V32"))  # byte by byte
            np.maximum.at(winners, at[hit], rows["top"].to_numpy(np.int64)[hit])
            np.add.at(counts, at[hit], rows["n"].to_numpy(np.int64)[hit])
            parts.append(pd.DataFrame({"digest": [d.tobytes() for d in digests], "top": winners,
                                       "n": counts, "member": True}))
            rows = rows[~hit]
        parts.append(rows[["digest", "top", "n"]].assign(member=False))
        return pd.concat(parts, ignore_index=True)

    return (index.groupBy("bucket").cogroup(
        new.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket"))
        .applyInPandas(probe, "digest binary, top long, n long, member boolean"))


def dedup(docs: DataFrame, is_history: Column, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size, kept, text_sha256, and known (the text is in history).

    ``is_history`` (null counts as false) says which documents were there before."""
    rest = docs.drop("keep_id", "group_size", "kept", "text_sha256", "known")
    digest, old = unused(rest, "digest", "is_history")
    marked = rest.withColumns({digest: digest_of(F.col(text)),
                               old: F.coalesce(is_history, F.lit(False))})
    history = written(reduced(marked.where(old), doc_id, digest))
    new = written(reduced(marked.where(~F.col(old)), doc_id, digest))
    buckets = max(1, -(-max(history.count(), new.count()) // BUCKET))
    index = written(build_index(history, buckets))
    looked = written(look_up(index, new, buckets))
    members = looked.where("member").select("digest", "top", "n", F.lit(True).alias("known"))
    others = looked.where("NOT member").groupBy("digest").agg(
        F.max("top").alias("top"), F.sum("n").alias("n")).withColumn("known", F.lit(False))
    winners = members.union(others).select(
        F.col("digest").alias(digest), F.expr(f"nullif(top, {_NONE})").alias("keep_id"),
        F.col("n").alias("group_size"), "known")
    return (marked.drop(old).join(winners, digest, "left")
            .withColumns({"kept": F.col(doc_id).cast("long").eqNullSafe(F.col("keep_id")),
                          "text_sha256": F.lower(F.hex(F.col(digest)))})
            .select(*rest.columns, "keep_id", "group_size", "kept", "text_sha256", "known"))
