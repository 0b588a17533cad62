"""Passages of three or more lines that occurred before are removed.

Every three consecutive lines make a window; windows overlap, so a passage of any length is a run of
windows. A window's first occurrence, by document id, row and line, stays; each later occurrence covers
its three lines, and covered lines go. A line that goes is still there: in the first occurrence of
its window, or, if that was covered too, in an even earlier one.

1. Where ids are null or repeat, rows are numbered in a written table. Lines are hashed in place, once; a window is the 128-bit hash of its lines, its document and its
   place. The windows are a written table, read by both steps below.
2. Windows are counted with a partial aggregate that also keeps the first place. Only windows that
   occur again go on; they meet the windows of all documents by hash, so a passage found in a third of
   all documents is a join key with many rows on one side and one on the other, which adaptive
   execution splits.
3. Each document gets the starts of its covered windows, merges them into lines, and drops those.

Defined cases: a null text or one of fewer than three lines has no window and stays as it is; rows
are documents of their own, also when they agree in id and text: one of them is the first, and what the
others repeat goes. Null ids come first. Empty lines are lines. Empty tables work. A text all
of whose lines are covered becomes empty. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import let, small, told_apart, unused, written

WINDOW = 3


def _windows(text: Column) -> Column:
    """array<struct<a, b, at>>: both halves of every window's hash and its first line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x, F.length(x)).alias("b")))

    def of(i: Column, hashes: Column) -> Column:
        row = [F.get(hashes, i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*[r.a for r in row]).alias("a"),
                        F.xxhash64(*[r.b for r in row]).alias("b"), i.alias("at"))

    return F.flatten(F.transform(F.array(lines), lambda h: F.when(
        F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                                         lambda i: of(i, h)))))


def covered_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    row: str = "row") -> DataFrame:
    """(row, starts): for every row that repeats something, the first lines of its covered windows in
    order. ``row`` numbers the rows; documents are in order of their id, then of that."""
    windows = written(
        docs.where(F.col(text).contains("\n"))
        .select(F.col(doc_id).cast("long").alias("id"), F.col(row).alias("row"),
                F.explode(_windows(F.col(text))).alias("w"))
        .select("w.a", "w.b", "id", "row", "w.at"))
    place = F.struct("id", "row", "at")
    repeated = written(windows.groupBy("a", "b").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
        .select("a", "b", "first"))
    later = windows.join(small(repeated), ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def without(text: Column, starts: Column) -> Column:
    """``text`` without the lines that the windows at ``starts`` (in order) cover: what lies between
    the end of one window and the start of the next, and the rest behind the last."""
    def gaps(x: Column) -> Column:
        lines, at = x["lines"], x["starts"]

        def gap(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j - 1) + WINDOW, F.lit(0))  # of the window before
            return F.when(start > end, F.slice(lines, end + 1, start - end)).otherwise(
                F.array().cast("array<string>"))

        tail = F.element_at(at, -1) + WINDOW
        return F.concat(F.flatten(F.transform(at, gap)),
                        F.slice(lines, tail + 1, F.size(lines)))

    return F.array_join(let(F.struct(F.split(text, "\n").alias("lines"), starts.alias("starts")),
                            gaps), "\n")


def n_covered(starts: Column) -> Column:
    return F.aggregate(F.transform(starts, lambda s, j: F.least(
        F.lit(WINDOW), s - F.coalesce(F.get(starts, j - 1), s - WINDOW))),
        F.lit(0), lambda a, b: a + b)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and n_removed: how many they were."""
    docs = docs.drop("n_removed")
    row, starts = unused(docs, "line_row", "line_starts")
    # rows need numbers, and a copy that keeps them, only where ids don't tell them apart
    numbered = (docs.withColumn(row, F.col(doc_id).cast("long")) if told_apart(docs, doc_id)
                else written(docs.withColumn(row, F.monotonically_increasing_id())))
    gone = written(covered_windows(numbered, doc_id, text, row)).withColumnsRenamed(
        {"row": row, "starts": starts})
    # the same plan at every size: texts are shuffled once, however few documents lose lines
    joined = numbered.join(gone.hint("merge"), row, "left")
    return joined.withColumns({
        text: F.when(F.col(starts).isNull(), F.col(text)).otherwise(
            without(F.col(text), F.col(starts))),
        "n_removed": F.coalesce(n_covered(F.col(starts)), F.lit(0)),
    }).select(*docs.columns, "n_removed")
