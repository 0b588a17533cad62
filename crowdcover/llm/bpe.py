"""Byte-level BPE, encoding and decoding.

A text is cut by the vocabulary's pattern into pre-tokens. Two tiers give the ids of a pre-token:

1. a minimal perfect hash over the vocabulary finds the slot where its bytes must be if it is a
   token as a whole; the slot's bytes are compared;
2. any other pre-token is merged by a heap of candidate pairs over its linked bytes: the pair of
   lowest rank, leftmost first, until no pair has a rank.

What a worker has found for a chunk it remembers, within a bound. Texts are worked on in blocks of
about a million characters, so a worker's memory does not follow the size of a batch.

Defined cases: a null or empty text gives an empty array of ids; ids of null decode to no bytes; an
id outside the vocabulary is an error. Rows are independent: repeated rows, ties and any other
columns pass through; a column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from crowdcover.llm.common import as_texts, batches
from crowdcover.llm.perfect_hash import PerfectHash, keys_of
from crowdcover.llm.words import REMEMBERED, single_blanks, stops_end_words

#: Characters of text that are cut and looked up together.
BLOCK = 1_000_000

def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import xxhash

        self.tokens = read_ranks(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.digest = xxhash.xxh3_128_digest
        keys = keys_of([self.digest(t) for t in self.tokens])
        self.hash = PerfectHash.build(keys)
        self.slots = np.empty(len(keys), dtype=np.int64)  # slot -> id
        self.slots[self.hash.find(keys)] = np.arange(len(keys))
        self.known: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def whole(self, words: list[bytes]) -> list[int]:
        """First tier: the id of every word that is a token, -1 for the others."""
        if not words:
            return []
        found = self.hash.find(keys_of([self.digest(w) for w in words]))
        ids = np.where(found >= 0, self.slots[found], -1).tolist()
        return [i if i >= 0 and self.tokens[i] == w else -1 for i, w in zip(ids, words)]

    def merged(self, word: bytes) -> list[int]:
        """Second tier: merges from single bytes on."""
        get, n = self.ranks.get, len(word)
        part = [word[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(word[i:i + 2], -1) for i in range(n - 1)] + [-1]  # rank of a part and the next
        wide = n.bit_length()
        heap = [(rank << wide) + i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << wide) - 1)
            if pair[i] != top >> wide:
                continue  # one of the two has been merged since
            j = after[i]
            part[i] = joined = part[i] + part[j]
            part[j], pair[j], pair[i] = b"", -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get(joined + part[k], -1)) >= 0:
                    pair[i] = rank
                    heapq.heappush(heap, (rank << wide) + i)
            h = before[i]
            if h >= 0:
                pair[h] = rank = get(part[h] + joined, -1)
                if rank >= 0:
                    heapq.heappush(heap, (rank << wide) + h)
        return [self.ranks[p] for p in part if p]

    def chunks(self, text: str) -> list[str]:
        """Pieces at whose ends the pattern always cuts: words with the space before them, line
        ends, and stops where they end words. A text with other white space is one piece."""
        if "\0" in text or not single_blanks(text):
            return [text]
        if stops_end_words(text):
            text = text.replace(",", "\0,").replace(".", "\0.")
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, as bytes of 32-bit numbers."""
        cut = {c: [c.encode()] if (c[1:] if c[:1] == " " else c).isalpha()
               else [w.encode() for w in self.split(c)] for c in chunks}
        words = list(set().union(*cut.values()))
        ids = {w: [i] if i >= 0 else self.merged(w) for w, i in zip(words, self.whole(words))}
        return {c: array("i", [i for w in ws for i in ids[w]]).tobytes() for c, ws in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        out, open_, new = [], [], set()
        for text in texts:
            chunks = self.chunks(text)
            got = list(map(self.known.get, chunks))
            if None in got:
                new.update(c for c, ids in zip(chunks, got) if ids is None)
                open_.append((len(out), chunks, got))
                out.append(b"")
            else:
                out.append(b"".join(got))
        learnt = self.learn(new)
        for at, chunks, got in open_:
            out[at] = b"".join([learnt[c] if ids is None else ids for c, ids in zip(chunks, got)])
        for chunk, ids in learnt.items():
            if len(self.known) < REMEMBERED and len(chunk) <= 40:
                self.known[chunk] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[at].tobytes()


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _with(df: DataFrame, out: str, kind) -> tuple[DataFrame, StructType]:
    rest = df.drop(out)
    return rest, StructType([*rest.schema.fields, StructField(out, kind)])


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``df`` with the ids of column ``text`` as array<int> ``out``."""
    if out == text:
        raise ValueError("the ids need a column of their own")
    df, schema = _with(df, out, ArrayType(IntegerType(), False))

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in rows:
            done = [ids for block in _blocks(as_texts(batch[text])) for ids in c.encode(block)]
            sizes = np.array([0, *map(len, done)], dtype=np.int64) // 4
            ids = pa.ListArray.from_arrays(
                pa.array(np.cumsum(sizes), pa.int32()),
                pa.array(np.frombuffer(b"".join(done), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return batches(df, work, schema)


def decode(df: DataFrame, ids: str, path: str, pattern: str, out: str = "bytes") -> DataFrame:
    """``df`` with the bytes that the ids of array<int> ``ids`` stand for as binary ``out``."""
    df, schema = _with(df, out, BinaryType())

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in rows:
            done = [c.decode(np.asarray(row.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                             if row.is_valid else np.empty(0, dtype=np.int64)) for row in batch[ids]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())],
                                             [*batch.schema.names, out])

    return batches(df, work, schema)


def sha256_of_ids(ids: str) -> Column:
    """Digest of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
