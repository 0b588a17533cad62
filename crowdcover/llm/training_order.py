"""Documents as token sequences in training order, in files that are read from any point on.

The ids of all documents, each closed by an end id, are one stream cut every ``length`` ids. Sequence
number n gets the global slot P(n), where P is a keyed Feistel permutation of the next power of four,
walked along its cycle until the result is a sequence number. Any worker computes a slot, and its
inverse, from the key alone. Slots are dealt to shards in ranges, and every shard is one file of
records of the same number of bytes:

    slot s  ->  file s // shard, byte (s % shard) * length * 2

1. Every task tokenizes its documents and numbers its ids from 0; this is written as a table, so the
   order of the stream stays as it is if executors are lost.
2. The number of ids per task, summed up, gives the place of every task's stream.
3. Every piece of a document goes to the task of its range of slots, is sorted there, and appended.
   Slots are even by construction, so ranges are equal shares without a sample of the pieces.
   A file gets its name only when it is complete; writing it again gives the same bytes.

Records are 16-bit numbers, little-endian; the last sequence is filled up with the end id. The
vocabulary must have at most 65,536 ids.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own; a
null id stays null in the index; an empty table gives no sequence. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdcover.llm.common import as_texts, batches, fresh_folder, small, written
from crowdcover.llm.words import word_encoder

ROUNDS = 6


class Permutation:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1)
                               & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << shift) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


@dataclass(frozen=True)
class Layout:
    """What a reader has to know of a written order."""

    folder: str
    length: int
    shard: int
    sequences: int
    ids: int
    key: int
    end_id: int

    @property
    def stride(self) -> int:
        return 2 * self.length

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard)


def shard_name(number: int) -> str:
    return f"shard-{number:09d}.bin"


def streams(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(part, at, n, doc_id, ids): the compressed 16-bit ids of every document, and their place in
    the stream of their task."""
    schema = "part int, at long, n long, doc_id long, ids binary"

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for batch in rows:
            ats, sizes, packed = [], [], []
            for coded in encoder.encode_all(as_texts(batch[1])):
                ids = np.frombuffer(coded + end_id.to_bytes(4, "little"), "<u4")
                if int(ids.max()) > 0xFFFF:
                    raise ValueError("an id does not fit 16 bits")
                ats.append(at)
                sizes.append(len(ids))
                at += len(ids)
                packed.append(press.compress(ids.astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ats), pa.int32()), pa.array(ats, pa.int64()),
                 pa.array(sizes, pa.int64()), batch[0], pa.array(packed, pa.binary())],
                ["part", "at", "n", "doc_id", "ids"])

    return batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), work, schema)


def materialise(docs: DataFrame, tokenizer: str, key: int, length: int = 2048, shard: int = 1024,
                end_id: int = 2, folder: str | None = None, doc_id: str = "doc_id",
                text: str = "text") -> tuple[Layout, DataFrame]:
    """Writes the shards; gives their layout and the index: (slot, number, shard, at_byte, doc_ids,
    starts, lengths, ids_crc32), one row per sequence. ``starts``: ids of the document before what
    of it is in the sequence. ``folder`` is one that all executors reach."""
    spark = docs.sparkSession
    staged = written(streams(docs, tokenizer, end_id, doc_id, text), "uncompressed")
    sums = written(staged.groupBy("part").agg(F.sum("n").alias("n")))
    place = written(sums.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
                    .select("part", "base"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    layout = Layout(folder or fresh_folder(docs), length, shard, -(-total // length), total, key, end_id)
    store, root = pyarrow.fs.FileSystem.from_uri(_uri(layout.folder))
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps(asdict(layout)).encode())

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(layout.sequences, key)
        opened = zstandard.ZstdDecompressor()
        press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for batch in rows:
            numbers, offs, keys, starts, sizes, parts = [], [], [], [], [], []
            for key_, at, packed in zip(batch["doc_id"].to_pylist(), batch["at"].to_pylist(),
                                        batch["ids"].to_pylist()):
                ids, start = opened.decompress(packed), 0
                n = len(ids) // 2
                while start < n:
                    number, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    numbers.append(number)
                    offs.append(off)
                    keys.append(key_)
                    starts.append(start)
                    sizes.append(size)
                    parts.append(packed if size == n else
                                 press.compress(ids[2 * start:2 * (start + size)]))
                    start += size
            slots = order.slots(numbers) if numbers else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // shard, pa.int32()), pa.array(slots, pa.int64()),
                 pa.array(numbers, pa.int64()), pa.array(offs, pa.int32()),
                 pa.array(keys, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())],
                ["shard", "slot", "number", "off", "doc_id", "start", "size", "ids"])

    based = staged.join(small(place), "part").select(
        (F.col("at") + F.col("base")).alias("at"), "doc_id", "ids")
    dealt = batches(based, cut, "shard int, slot long, number long, off int, doc_id long, "
                                "start long, size int, ids binary")
    # slots are spread evenly, so equal ranges of shards are equal shares, and nothing need be sampled
    tasks = max(1, min(layout.shards, max(layout.shards // 4, spark.sparkContext.defaultParallelism)))
    spread = dealt.repartitionById(tasks, F.expr(f"CAST(CAST(shard AS bigint) * {tasks} DIV "
                                                 f"{max(1, layout.shards)} AS int)"))
    index = batches(spread.sortWithinPartitions("slot", "off"),
                    _writer(layout), "slot long, number long, shard int, at_byte long, "
                    "doc_ids array<long>, starts array<long>, lengths array<int>, ids_crc32 long")
    return layout, written(index)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _writer(layout: Layout):
    """Appends sorted pieces to the file of their shard, one record in memory at a time."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(_uri(layout.folder))
        opened = zstandard.ZstdDecompressor()
        task = TaskContext.get().taskAttemptId()
        out = name = at = None  # the open file, its number, the slot it has come to
        record: list[bytes] = []
        about: list[tuple] = []
        done: list[tuple] = []

        def close_record() -> None:
            ids = b"".join(record)
            done.append((at, about[0][0], name, at % layout.shard * layout.stride,
                         [a[1] for a in about], [a[2] for a in about], [a[3] for a in about],
                         zlib.crc32(ids)))
            out.write(ids + layout.end_id.to_bytes(2, "little")
                      * ((layout.stride - len(ids)) // 2))

        def close_file() -> None:
            out.close()
            mine, whole = f"{root}/_{shard_name(name)}.{task}", f"{root}/{shard_name(name)}"
            try:
                store.move(mine, whole)
            except OSError:  # a task that ran before left the same file, and this store keeps what is there
                if store.get_file_info(whole).size != store.get_file_info(mine).size:
                    raise
                store.delete_file(mine)

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
            names = ["slot", "number", "shard", "at_byte", "doc_ids", "starts", "lengths", "ids_crc32"]
            columns = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in rows:
            for row in batch.to_pylist():
                if row["slot"] != at and at is not None:
                    close_record()
                    record, about = [], []
                if row["shard"] != name:
                    if name is not None:
                        close_file()
                    name = row["shard"]
                    out = store.open_output_stream(f"{root}/_{shard_name(name)}.{task}")
                at = row["slot"]
                record.append(opened.decompress(row["ids"]))
                about.append((row["number"], row["doc_id"], row["start"], row["size"]))
            yield table()
        if at is not None:
            close_record()
            close_file()
        yield table()

    return work


def read_layout(folder: str) -> Layout:
    store, root = pyarrow.fs.FileSystem.from_uri(_uri(folder))
    with store.open_input_stream(f"{root}/layout.json") as file:
        return Layout(**json.loads(file.read()))


def read_slots(folder: str, first: int, last: int) -> Iterator[np.ndarray]:
    """The sequences of slots ``first`` up to ``last``, in order: one seek, then straight on. This is
    how a training run starts again where it stopped."""
    layout = read_layout(folder)
    store, root = pyarrow.fs.FileSystem.from_uri(_uri(folder))
    slot, last = first, min(last, layout.sequences)
    while slot < last:
        number = slot // layout.shard
        with store.open_input_file(f"{root}/{shard_name(number)}") as file:
            file.seek(slot % layout.shard * layout.stride)
            while slot < last and slot // layout.shard == number:
                yield np.frombuffer(file.read(layout.stride), "<u2")
                slot += 1


def read_records(spark: SparkSession, layout: Layout) -> DataFrame:
    """(slot, ids): every record of every shard, read back by Spark; ids are little-endian bytes."""
    stride, shard = layout.stride, layout.shard

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                first = int(path.rpartition("-")[2].removesuffix(".bin")) * shard
                n = len(content) // stride
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + n), pa.int64()),
                     pa.array([content[i * stride:(i + 1) * stride] for i in range(n)], pa.binary())],
                    ["slot", "ids"])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin")
             .load(layout.folder).select("path", "content"))
    return batches(files, work, "slot long, ids binary")
