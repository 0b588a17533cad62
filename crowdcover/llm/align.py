"""Tokens of two tokenizers over the same bytes, cut into groups where both end, and linked in them.

Both tokenizers encode a space and the text: A byte-level (a ``tokenizers`` file), B by pieces (a
``sentencepiece`` model, which adds the space itself). Intervals of both are coalesced:

1. the byte intervals of all A and B tokens are sorted by start; the running maximum of their ends
   tells how far any token has reached; where a start is not below it, both have ended: a new group;
2. inside a group every A token is linked with every B token. A group of very many tokens is
   expanded by distinct ids with multiplicities, so no list of all its occurrences is made;
3. corpus-wide, a pair of ids counts the documents that hold it linked; per A id the highest count
   marks its best partners.

No pre-token of A and no piece of B goes on from something else into a space or line end, so a text is
cut before the first of a run of those, and what a chunk gives (groups, links) is remembered by the worker, within a bound that
forgets chunks not met lately. Vocabularies for which that does not hold are found when a model is
loaded; their texts are aligned as a whole, with the same result.

Counts of the most frequent pairs, at most ``HEAD`` of them, travel to the tasks; links with any
other pair meet their counts in a join by pair, where no key is frequent. The best count per A id has
at most one row per entry of A's vocabulary.

Defined cases: a null or empty text, and one whose tokens do not give back its bytes (say, it holds the
sign that stands for a space in B), has no tokens: zeros, and '' for the digest. Rows are told apart
by a number of their own, so null and repeated ids and repeated rows are documents of their own.
Empty tables work; other columns are not read. A document's own distinct pairs are in memory at
once, no more than the product of the distinct ids inside each of its groups.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import as_texts, batches, written
from crowdcover.llm.words import Recent

#: Pairs whose counts travel to every task: 13 bytes each.
HEAD = 1_000_000
#: Characters of text that are aligned together.
BLOCK = 1_000_000
#: Links of a group beyond which its ids are made distinct first.
WIDE = 1_024
#: Characters of the longest chunk that is remembered.
LONGEST = 40

_PLAIN = re.compile(r"[ \n]+[^ \n]*")
#: Other white space may belong to what stands before it, in A or in B: cuts only where none does.
_ODD = re.compile(r"[^\S \n]")
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")
_SPACE = "▁"
_SHIFT = 40

_ALIGNED = ("doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, pairs array<long>, times array<int>")


def _byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it can be
    printed, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        value = _byte_values()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = (bytes(map(value.__getitem__, token)) if all(c in value for c in token)
                             else token.encode())
        before = plan.get("pre_tokenizer") or {}
        self.cuts = (plan.get("normalizer") is None and before.get("type") == "ByteLevel"
                     and before.get("use_regex", True) and not before.get("add_prefix_space"))

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                      else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id(_SPACE)
        normal = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        probe = "  a  ﬁ A\n b\t "
        self.cuts = (self.model.normalize(probe) == (_SPACE + probe.replace(" ", _SPACE))
                     and self.model.encode("\na")[:1] == [self.space]
                     and not any(_SPACE in p.lstrip(_SPACE) or len(p) > 1 and "\n" in p
                                 for p in normal))

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Of chunks that begin with a space or line end. The model puts a space before what it is given: it
        takes the place of a chunk's own, and is dropped where the chunk begins otherwise."""
        out = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [[self.space] if c == " " else ids if c[0] == " " else ids[1:]
                for c, ids in zip(chunks, out)]


def coalesced(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the intervals by start, and the number of the group of each in that order."""
    order = np.lexsort((kinds, starts))
    reach = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), dtype=np.int64)
    new[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(new) - 1


class Aligner:
    """Aligns texts; remembers chunks. An entry is (token and group counts in one number, groups as
    text, links as bytes of 64-bit codes, distinct links of wide groups with their times)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.cuts = self.a.cuts and self.b.cuts
        self.size_a = np.array([len(t) for t in self.a.bytes], dtype=np.int64)
        self.size_b = np.array([len(t) for t in self.b.bytes], dtype=np.int64)
        self.stride = len(self.b.bytes)
        most = max(len(self.a.bytes), self.stride)
        digits = np.array([str(i) for i in range(most)], dtype="S")
        self.digits = np.zeros((most, digits.itemsize + 1), dtype=np.uint8)
        self.digits[:, :-1] = digits.view(np.uint8).reshape(most, -1)
        self.known = Recent()

    def chunks(self, text: str) -> list[str]:
        text = " " + text
        if not self.cuts:
            return [text]
        return _CUTS.split(text) if _ODD.search(text) else _PLAIN.findall(text)

    def learn(self, chunks: list[str]) -> list[tuple | None]:
        """The entry of every chunk; None where its tokens do not give back its bytes."""
        wanted = [c.encode() for c in chunks]
        ids_a, ids_b = self.a.encode(chunks), self.b.encode(chunks)
        of_a, of_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        good = [b"".join(map(of_a, x)) == w == b"".join(map(of_b, y))
                for w, x, y in zip(wanted, ids_a, ids_b)]
        entries = self.entries([len(w) for w, g in zip(wanted, good) if g],
                               [x for x, g in zip(ids_a, good) if g],
                               [y for y, g in zip(ids_b, good) if g])
        return [next(entries) if g else None for g in good]

    def entries(self, sizes: list[int], ids_a: list[list[int]], ids_b: list[list[int]]) -> Iterator[tuple]:
        if not sizes:
            return iter(())
        count = [np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b)]
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        # chunks lie one behind the other: both vocabularies tile the same bytes
        width = np.concatenate([self.size_a[a], self.size_b[b]])
        ends = np.concatenate([np.cumsum(width[:len(a)]), np.cumsum(width[len(a):])])
        starts = ends - width
        kinds = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        order, group = coalesced(starts, ends, kinds)
        groups = int(group[-1]) + 1
        n_a, n_b = (np.bincount(group[kinds[order] == k], minlength=groups) for k in (0, 1))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        bounds = np.cumsum([0, *sizes])
        chunk_of = np.searchsorted(bounds, starts[order][first], side="right") - 1  # of a group
        chunk_groups = np.bincount(chunk_of, minlength=len(sizes))

        texts, ends_of_text = self.written_groups(np.concatenate([a, b]), order, group, kinds, chunk_of,
                                                  len(sizes))
        codes, links, wide = self.links(a, b, n_a, n_b, chunk_of, len(sizes))
        at_text, at_link = 0, 0
        out = []
        for i, (x, y, g, t, m) in enumerate(zip(count[0].tolist(), count[1].tolist(), chunk_groups.tolist(),
                                                ends_of_text.tolist(), np.cumsum(links).tolist())):
            out.append((x | y << _SHIFT | g << 2 * _SHIFT, texts[at_text:t - 1],
                        codes[8 * at_link:8 * m], wide.get(i)))
            at_text, at_link = t, m
        return iter(out)

    def written_groups(self, ids, order, group, kinds, chunk_of, n) -> tuple[bytes, np.ndarray]:
        """All groups as text, with a separator behind every token, and where each chunk ends."""
        by = np.argsort(group * 2 + kinds[order], kind="stable")
        kind, group = kinds[order][by], group[by]
        rows = self.digits[ids[order][by]]
        behind = np.full(len(by), ord(";"), dtype=np.uint8)
        same = group[1:] == group[:-1]
        behind[:-1][same] = np.where(kind[1:] == kind[:-1], ord(","), ord("|"))[same]
        rows[:, -1] = behind
        shown = rows != 0
        ends = np.cumsum(np.bincount(chunk_of[group], weights=shown.sum(axis=1), minlength=n))
        return rows[shown].tobytes(), ends.astype(np.int64)

    def links(self, a, b, n_a, n_b, chunk_of, n) -> tuple[bytes, np.ndarray, dict]:
        """Codes of the links of all narrow groups, their number per chunk, and per chunk the
        distinct links of its wide groups with their times."""
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        narrow = n_a * n_b <= WIDE
        group_of = np.repeat(np.arange(len(n_a)), n_a)
        left = np.flatnonzero(narrow[group_of])
        times = n_b[group_of[left]]
        total = int(times.sum())
        which = np.repeat(at_b[group_of[left]] - (np.cumsum(times) - times), times) + np.arange(total)
        codes = np.repeat(a[left], times) * self.stride + b[which]
        links = np.bincount(chunk_of, weights=np.where(narrow, n_a * n_b, 0), minlength=n).astype(np.int64)
        wide: dict[int, list] = {}
        for g in np.flatnonzero(~narrow):
            x, nx = np.unique(a[at_a[g]:at_a[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b[at_b[g]:at_b[g] + n_b[g]], return_counts=True)
            wide.setdefault(int(chunk_of[g]), []).append(
                ((x[:, None] * self.stride + y).ravel(), (nx[:, None] * ny).ravel()))
        return codes.tobytes(), links, wide

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, distinct pairs, times) of every text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        unseen = self.known.missing(cut)
        learnt = dict(zip(unseen, self.learn(unseen))) if unseen else {}
        found = [self.known.of(chunks, learnt) for chunks in cut]
        # a chunk that does not come back: the text as a whole decides
        whole = [i for i, entries in enumerate(found) if None in entries]
        for i, entry in zip(whole, self.learn([" " + texts[i] for i in whole]) if whole else ()):
            found[i] = [entry] if entry is not None else []
        self.known.add({c: e for c, e in learnt.items() if len(c) <= LONGEST})
        return [self.document(entries) for entries in found]

    def document(self, entries: list[tuple]) -> tuple:
        if not entries:
            empty = np.empty(0, np.int64)
            return 0, 0, 0, 0, "", empty, empty
        counts = sum(map(itemgetter(0), entries))
        mask = (1 << _SHIFT) - 1
        text = b";".join(map(itemgetter(1), entries))
        pairs, times = np.unique(np.frombuffer(b"".join(map(itemgetter(2), entries)), np.int64),
                                 return_counts=True)
        more = [w for e in entries if e[3] for w in e[3]]
        if more:
            codes = np.concatenate([pairs, *[c for c, _ in more]])
            weights = np.concatenate([times, *[t for _, t in more]])
            pairs, at = np.unique(codes, return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, at, weights)
        return (counts & mask, counts >> _SHIFT & mask, counts >> 2 * _SHIFT, int(times.sum()),
                hashlib.sha256(text).hexdigest(), pairs, times)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _blocks(ids: list, rows: list, texts: list[str]) -> Iterator[tuple[list, list, list[str]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or i + 1 == len(texts):
            yield ids[first:i + 1], rows[first:i + 1], texts[first:i + 1]
            first, size = i + 1, 0


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per document: its id and number, counts, digest of its groups, distinct linked pairs as
    codes (A's id times the size of B's vocabulary, plus B's id) and how often each is linked."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(path_a, path_b)
        for batch in rows:
            for ids, numbers, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                               as_texts(batch.column(2))):
                done = one.align(texts)
                ends = pa.array(np.cumsum([0, *[len(d[5]) for d in done]]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()),
                     *[pa.array([d[k] for d in done], pa.int64()) for k in range(4)],
                     pa.array([d[4] for d in done], pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate([d[5] for d in done]))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(
                         [d[6] for d in done]).astype(np.int32)))],
                    [c.split()[0] for c in _ALIGNED.split(", ")])

    return batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                               F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")),
                   work, _ALIGNED)


def pair_counts(table: DataFrame, stride: int) -> DataFrame:
    """(pair, a, b, n, best): documents that hold each pair linked, and whether no pair of the same
    A id has more. ``table``: pairs; ``stride``: size of B's vocabulary."""
    counts = written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("n")).withColumns({
            "a": F.expr(f"pair div {stride}"), "b": F.expr(f"pair % {stride}")}))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row per entry of A's vocabulary
    return counts.join(F.broadcast(top), "a").select(
        "pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _head(counts: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The rows of ``counts`` with the highest counts, at most ``limit`` of them; whether that is all."""
    rows = counts.count()
    if rows <= limit:
        return counts, True
    share = limit / rows / 2
    while True:
        least = counts.agg(F.percentile_approx("n", F.lit(1 - share))).first()[0]
        head = counts.where(F.col("n") > least)
        if head.count() <= limit:
            return head, False
        share /= 2


def scored(table: DataFrame, counts: DataFrame, limit: int = HEAD) -> DataFrame:
    """``table`` without its pairs, with n_best (links that are best for their A id) and count_sum (the
    counts of all links)."""
    head, all_ = _head(counts, limit)
    near = head.select("pair", "n", "best").toArrow()  # bounded by limit
    order = np.argsort(keys := near["pair"].to_numpy())
    shared = table.sparkSession.sparkContext.broadcast(
        (keys[order], near["n"].to_numpy()[order], near["best"].to_numpy(zero_copy_only=False)[order]))
    rest = [c for c in table.columns if c not in ("pairs", "times")]

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in rows:
            pairs, sizes = (batch["pairs"].flatten().to_numpy(zero_copy_only=False),
                            np.diff(batch["pairs"].offsets.to_numpy()))
            times = batch["times"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(keys, pairs)
            hit = np.zeros(len(pairs), bool)
            if len(keys):
                at = np.minimum(at, len(keys) - 1)
                hit = keys[at] == pairs
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], doc[hit], times[hit] * n[at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * best[at[hit]])
            ends = pa.array(np.cumsum([0, *np.bincount(doc[~hit], minlength=batch.num_rows)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in rest], pa.array(sums[0]), pa.array(sums[1]),
                 pa.ListArray.from_arrays(ends, pa.array(pairs[~hit], pa.int64())),
                 pa.ListArray.from_arrays(ends, pa.array(times[~hit], pa.int64()))],
                [*rest, "count_sum", "n_best", "far", "far_times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in rest)
    near = batches(table, work, f"{kinds}, count_sum long, n_best long, far array<long>, "
                                "far_times array<long>")
    if all_:
        return near.drop("far", "far_times")
    near = written(near)
    far = (near.select("row", F.inline(F.arrays_zip("far", "far_times"))).withColumnRenamed("far", "pair")
           .join(counts, "pair").groupBy("row").agg(
               F.sum(F.col("far_times") * F.col("n")).alias("more"),
               F.sum(F.when(F.col("best"), F.col("far_times"))).alias("more_best")))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return near.join(far, "row", "left").select(
        *rest, plus("count_sum", "more"), plus("n_best", "more_best"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
                      text: str = "text", limit: int = HEAD) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, count_sum, n_best) per document."""
    table = written(aligned(docs, path_a, path_b, doc_id, text))
    counts = written(pair_counts(table, len(Pieces(path_b).bytes)))
    return scored(table, counts, limit)
