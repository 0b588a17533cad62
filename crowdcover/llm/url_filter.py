"""URLs judged by a list: a blocked Bloom filter lets possible hits through to an exact join.

The list has two kinds of entries. A *rule* has a host, a path and a verdict, and fits a URL on its
host or a subdomain whose path starts with the rule's path; the longest rule that fits decides. A
*listed URL* is one canonical URL (host in lower case, path without slashes at its end) with a verdict
that counts where no rule fits. A URL therefore has few candidate keys: each suffix of its host that
starts at a label, with each beginning of its path that is as long as some rule's path, and its own
canonical form.

1. The filter: every listed key sets eight bits of one block of 256. The bits are or-ed by block with
   a partial aggregate, and only the blocks, at most MAX_BLOCKS of 32 bytes, come to the driver.
   A list too long for that only makes the filter let more through.
2. Every URL's candidates are hashed in the JVM and looked up in the filter, one block each. Most
   URLs have no candidate left and are done, without a shuffle.
3. The remaining candidates, each once, meet the list by an exact hash join on host and path; that
   removes false positives. The longest entry per URL goes back to the rows of that URL.

A host or entry that fits a third of all URLs is a hot key of joins that only aggregate before or
after; adaptive execution splits them.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no entry; an
entry without a host or with a null is ignored; of equal entries with different verdicts the
smallest verdict counts, of rules of equal length the one with the longer host. Every row is
judged, repeated ones too; other columns pass through, except those with the names of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from crowdcover.llm.common import batches, small, unused, written

#: Bits per listed key, of which eight are set.
BITS = 16
#: 8 MB at most, whatever the length of the list.
MAX_BLOCKS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def exact_path(path: Column) -> Column:
    """The path part of a listed URL's key; no beginning of a path starts like this."""
    return F.concat(F.lit("="), F.regexp_replace(path, "/+$", ""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """array<struct<h, p>> of the keys under which a fitting entry may be listed."""
    starts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.flatten(F.transform(suffixes(host), lambda h: F.transform(
        F.filter(starts, lambda n: n <= F.length(path)),
        lambda n: F.struct(h.alias("h"), F.substring(path, F.lit(1), n).alias("p")))))
    own = F.array(F.struct(host.alias("h"), exact_path(path).alias("p")))
    return F.when(host == "", F.array().cast("array<struct<h:string,p:string>>")).otherwise(
        F.concat(prefixes, own))


def _spots(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of every key, and its eight bits: one in each of eight 32-bit words."""
    odd = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D,
                    0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
    keys = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        bit = (((keys[:, None] & _U(0xFFFFFFFF)) * odd) & _U(0xFFFFFFFF)) >> _U(27)
        return ((keys >> _U(32)) * _U(blocks)) >> _U(32), (_U(1) << bit).astype(np.uint32)


def build_filter(listed: DataFrame) -> np.ndarray:
    """Blocks of eight words, from the column ``key`` of ``listed``."""
    n = listed.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 256 < n * BITS:
        blocks *= 2

    def spots(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            block, words = _spots(np.asarray(batch["key"]), blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int64))] + [pa.array(words[:, i].astype(np.int64))
                                                      for i in range(8)],
                ["block"] + [f"w{i}" for i in range(8)])

    fields = ", ".join(["block long"] + [f"w{i} long" for i in range(8)])
    rows = (batches(listed.select("key"), spots, fields).groupBy("block")
            .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toPandas())
    table = np.zeros((blocks, 8), dtype=np.uint32)
    if len(rows):
        table[rows["block"].to_numpy()] = rows.drop(columns="block").to_numpy().astype(np.uint32)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, words = _spots(keys, len(table))
    return ((table[block.astype(np.int64)] & words) == words).all(axis=1)


def possible(df: DataFrame, keys: str, table: np.ndarray, out: str) -> DataFrame:
    """``df`` with array<boolean> ``out``: which of the hashes in ``keys`` the filter lets through."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = batch[keys]
            found = may_hold(shared.value, np.asarray(column.flatten()).astype(np.int64))
            sizes = np.diff(np.asarray(column.offsets))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found))],
                [*batch.schema.names, out])

    return batches(df, work, StructType([*df.schema.fields,
                                         StructField(out, ArrayType(BooleanType()))]))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url",
          default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides, else null) and
    verdict (the rule's, else the listed URL's, else ``default``).

    ``rules``: (host, path, verdict), ``listed``: (url, verdict)."""
    prefix = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"),
                          F.col("path").alias("p"), "verdict", F.lit(True).alias("is_rule"))
    exact = listed.select(host_of(F.col("url")).alias("h"), exact_path(path_of(F.col("url"))).alias("p"),
                          "verdict", F.lit(False).alias("is_rule"))
    entries = written(
        prefix.union(exact).where("h <> '' AND p IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("h", "p", "is_rule").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", key_of(F.col("h"), F.col("p"))))
    # lengths of paths: at most as many as the longest rule has characters
    lengths = sorted(r[0] for r in entries.where("is_rule").select(F.length("p")).distinct().collect())
    table = build_filter(entries)

    rest = pages.drop("host", "path", "rule", "verdict")
    cand, keys, hit = unused(rest, "candidates", "keys", "possible")
    parsed = rest.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parsed = parsed.withColumn(cand, candidates(F.col("host"), F.col("path"), lengths))
    parsed = parsed.withColumn(keys, F.transform(cand, lambda c: key_of(c.h, c.p)))
    tested = possible(parsed.drop(cand), keys, table, hit)
    some = F.exists(hit, lambda b: b)

    left = (tested.where(some).select("host", "path", keys, hit).distinct()
            .withColumn(cand, candidates(F.col("host"), F.col("path"), lengths))
            .select("host", "path", F.explode(F.filter(
                F.arrays_zip(F.col(cand).alias("c"), F.col(hit).alias("hit")),
                lambda x: x["hit"])).alias("x"))
            .select("host", "path", "x.c.h", "x.c.p").withColumn("key", key_of(F.col("h"), F.col("p"))))
    found = (left.join(small(entries), ["key", "h", "p"]).groupBy("host", "path").agg(
        F.max(F.struct("is_rule", F.length(F.concat("h", "p")).alias("size"), F.length("h").alias("wide"),
                       F.when(F.col("is_rule"), F.concat("h", "p")).alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict"))
    columns = [*rest.columns, "host", "path"]
    hits = tested.where(some).select(columns).join(found, ["host", "path"], "left")
    misses = tested.where(~some).select(*columns, F.lit(None).cast("string").alias("rule"),
                                        F.lit(None).cast("string").alias("verdict"))
    return hits.select(misses.columns).union(misses).withColumn(
        "verdict", F.coalesce("verdict", F.lit(default)))
