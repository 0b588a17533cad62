"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length l is of class k = capacity // l: k pieces of that class always fit a sequence, and
a sequence of class k holds exactly k of them. Which sequence a piece goes to is then plain
arithmetic on its number within its class, so no worker waits for another.

Padding comes from pieces well below capacity / k. As documents may be cut, a long piece of a coarse
class is cut to capacity // (k + 1) exactly, until the rest is of a fine class, where the room left
over is at most 1 / FINE of a sequence.

1. Every task tokenizes its documents, cuts them, and numbers its pieces class by class. This is
   written as a table without texts and ids, so the numbers stay as they are if executors are lost.
2. The counts of every (task, class) give the first number of each; tasks times classes rows.
3. Number // k is the sequence within the class, number % k the place in it.
4. Each class has at most one sequence that isn't full, whatever the size of the input. Their pieces
   are fewer than :func:`leftover_bound`; they go to sequences largest first, in one small task.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are documents of
their own; a null id stays null; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdcover.llm.common import as_texts, batches, small, written
from crowdcover.llm.words import word_encoder

#: From this class on a piece is left uncut.
FINE = 64

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "part int, class int, nr long")


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= FINE or capacity - k * rest < capacity // FINE:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def leftover_bound(capacity: int) -> int:
    """Pieces that the sequences which aren't full can have together: below k for every class."""
    return sum(k - 1 for k in {capacity // length for length in range(1, capacity + 1)})


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str,
           text: str) -> DataFrame:
    """One row per piece, with its number within its class and task."""
    end = end_id.to_bytes(4, "little")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, numbers = word_encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
        for batch in rows:
            out: list[tuple] = []
            for key, coded in zip(batch[0].to_pylist(), encoder.encode_all(as_texts(batch[1]))):
                ids = coded + end
                n, at = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    k = capacity // length
                    out.append((key, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n,
                                part, k, numbers[k]))
                    numbers[k] += 1
                    at += length
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), work, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class): one row per piece.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its
    sequence. Sequences are numbered from 0 without gaps, class by class."""
    cut = written(pieces(docs, tokenizer, capacity, end_id, doc_id, text))
    counts = written(cut.groupBy("part", "class").agg(F.count("*").alias("n")))
    before = Window.partitionBy("class").orderBy("part")
    first = written(counts.withColumn("first", F.sum("n").over(before) - F.col("n"))
                    .select("part", "class", "first"))
    # one row per class, of which there are fewer than 2 * sqrt(capacity)
    classes = counts.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()
    sequences, known = 0, []
    for row in classes:
        known.append((row["class"], row["n"] // row["class"], sequences))
        sequences += known[-1][1]
    # a constant in the plan instead of a join
    table = F.create_map(*[F.lit(x) for k, full, at in known
                           for x in (k, F.struct(F.lit(full), F.lit(at)))]) if known else None
    numbered = cut.join(small(first), ["part", "class"]).withColumn(
        "nr", F.col("nr") + F.col("first")).drop("first", "part")
    if table is None:
        numbered = numbered.withColumns({"full": F.lit(0), "base": F.lit(0)})
    else:
        numbered = (numbered.withColumn("of", table[F.col("class")])
                    .withColumns({"full": F.col("of.col1"), "base": F.col("of.col2")}).drop("of"))
    whole = numbered.where("nr < full * class").withColumns(
        {"sequence_id": F.expr("base + nr div class").cast("long"), "place": F.expr("nr % class")})
    order = Window.partitionBy("sequence_id").orderBy("place")
    shared = whole.where("class > 1").withColumn(
        "offset", F.sum("length").over(order) - F.col("length"))
    alone = whole.where("class = 1").withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"]
    rest = numbered.where("nr >= full * class")
    return (alone.select(columns).union(shared.select(columns))
            .union(_largest_first(rest, capacity, sequences).select(columns)))


def _largest_first(rest: DataFrame, capacity: int, first_id: int) -> DataFrame:
    """Sequences for the few pieces that fill none of their class. Each goes to the fullest
    sequence with room for it; a heap per room left would do the same with more code."""
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, class int")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"],
                                  ascending=[False, True, True, True], kind="stable")
        rooms: dict[int, list[int]] = {}  # room left -> sequences with that room
        made, sequence, offset = 0, [], []
        for length in group["length"].tolist():
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, at, made = capacity, made, made + 1
            else:
                at = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            sequence.append(first_id + at)
            offset.append(capacity - room)
            if room > length:
                rooms.setdefault(room - length, []).append(at)
        return group.assign(sequence_id=sequence, offset=offset)

    wanted = [f.split()[0] for f in schema.split(", ")]
    return (rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
                        F.lit(True).alias("all"))
            .groupBy("all").applyInPandas(lambda g: fill(g)[wanted], schema))
