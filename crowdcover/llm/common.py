"""What the operators share: written tables, checked broadcasts, Arrow batches, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdcover.session import checkpoint_dir

#: Rows, and bytes of their texts, that a broadcast may have; beyond it both sides are shuffled.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32_000_000

#: White space of the word rules: space and \t to \r.
BLANKS = r"[ \t-\r]+"


def fresh_folder(df: DataFrame) -> str:
    """A new folder name under the shared folder of the session."""
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder. What was random or costly is fixed from here on, and
    a lost executor takes nothing with it."""
    path = fresh_folder(df)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more. It does so by
    itself when the driver collects garbage, which may be long after the disk is full."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written ``table``, marked for broadcast if a count shows that it has few rows and their texts are
    short. Without the mark the join shuffles both sides, and adaptive execution splits what is skewed."""
    texts = [f.name for f in table.schema if f.dataType.typeName() in ("string", "binary")]
    if not texts:
        return F.broadcast(table) if table.count() <= limit else table
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    rows, size = table.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(table) if rows <= limit and (size or 0) <= BROADCAST_BYTES else table


def few_tasks(rows: int) -> int:
    """Tasks for a table of ``rows`` short rows."""
    return max(8, rows // 50_000)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def told_apart(df: DataFrame, column: str) -> bool:
    """Whether the ids in ``column`` tell the rows of ``df`` apart: none is null, none comes twice."""
    ids = df.select(F.col(column).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.where("id IS NULL OR n > 1").isEmpty()


def batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
            schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that every node of ``edges`` (a, b) reaches.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest
    neighbour; the number of rounds grows with the logarithm of the longest chain. A round reads
    and leaves one written table; it ends when a round changes no edge. A node with very many
    neighbours costs one row per task: its minimum is taken before the shuffle.
    """
    def star(table: DataFrame, larger: bool, tasks: int, fits: bool) -> DataFrame:
        both = (table.select("a", "b").union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
                if larger else table)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
        joined = both.join(F.broadcast(low) if fits else low, "a")
        if larger:
            kept = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
                low.select("a", F.col("m").alias("b")))
        return kept.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks)

    now = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n = now.count()
        # as many tasks as the edges need, and no shuffle of edges while a row per node fits
        tasks, fits = few_tasks(n), 2 * n <= BROADCAST_ROWS
        after = written(star(star(now, True, tasks, fits), False, tasks, fits))
        if after.count() == n and after.join(small(now), ["a", "b"], "left_anti").isEmpty():
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())
