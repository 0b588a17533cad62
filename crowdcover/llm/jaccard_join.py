"""Documents whose word n-gram sets are alike: an exact Jaccard join, as classes of documents.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least a
threshold t. Everything below is exact; filters only leave out what cannot link.

1. *Copies.* Documents with equal sets are one class; from here on a class is one set.
2. *Who can have a partner at all.* In any total order of shingles, the first n - ceil(tn) + k of two
   linked sets share k. In the order of the hashes this needs no counts: each document hands on the
   beginning of its set, shingles that occur twice are counted, and a document with too few of them
   has no partner. Only the others, mostly near copies, go on.
3. *Rare first.* For those, shingles are counted exactly and each set is put in order of frequency.
   Shingles of one set alone come first and join with nothing, so they are only counted.
4. *Prefix join.* The rarest n - ceil(tn) + 1 shingles of a set probe, the rarest n - ceil(2t/(1+t) n)
   + 1 of sets no larger are indexed. The length filter and the positional filter, which bounds the
   overlap by what is left behind the matching places, are conditions of the join. So is the suffix
   filter: the shingles are split at fixed pivots into PARTS parts; a part whose counts differ in
   parity holds a shingle of only one of the two, which, with the shingles that a set has alone,
   bounds the overlap from above.
5. *Verification*, once per pair, by intersecting the sets.
6. *No pairs within a group.* A shingle's list is not paired with itself. First every list meets its
   leader, one set, and what is linked becomes a component. Then only pairs of different components
   in a list are left. While those are many, and each round halves them, lists meet other leaders,
   each set those few that it shares most lists with; whatever is left then is joined in full, each
   pair in the first list it shares. Pairs of one component are never made: they change no class.

The result is the class, so a pair within a component is left unverified; no link between components
is lost. Every step ends in a written table.

Defined cases: a null or empty text has no shingle and is linked with nothing, its component is its
own id; a text shorter than five words is one shingle; repeated rows are copies; equal ids with
different texts stay different documents, each with a row; a null id counts as smaller than any
other, and a component with such a document has component null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdcover.llm.common import (as_bytes, batches, components, few_tasks, free_shuffles,
                                   small, written)

WORDS = 5
#: Percent of a set by which its beginning in step 2 is longer than need be. More shingles are
#: counted then, and more documents drop out.
EXTRA = 6
#: Parts of the suffix filter, a multiple of 64: one bit each.
PARTS = 512
#: The pairs per prefix entry that are worth another round of leaders, and the leaders that a set
#: meets in a round.
WORTH, EACH = 2, 4
#: Shingles before its own that an entry brings to the last join, to tell that a pair met earlier.
EARLIER = 16

_U = np.uint64
_NONE = -(1 << 63)
_FACTORS = [_U(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                            0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(one))
    with np.errstate(over="ignore"):
        total = np.full(len(one) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            total = (total ^ (total >> _U(31))) * _FACTORS[k % 5] + one[k:k + len(total)]
        total = (total ^ (total >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        total ^= total >> _U(31)
    return np.unique(total)


def least(n, percent: int):
    """ceil(t n)."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, n, d1, d2, head): a hash of the text as it is, size and digest of every document's
    set, and its beginning in the order of the hashes."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes, digests, heads = [], [], []
            for doc in as_bytes(batch[2]):
                found = shingles(doc)
                n = len(found)
                sizes.append(n)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                heads.append(found[:n - least(n, percent) + 1 + n * EXTRA // 100].tobytes())
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()),
                 pa.array(halves[:, 1].copy()), pa.array(heads, pa.binary())],
                ["doc_id", "th", "n", "d1", "d2", "head"])

    return batches(docs.select(*_row(doc_id, text), F.col(text)), work,
                   "doc_id long, th long, n long, d1 long, d2 long, head binary")


def _row(doc_id: str, text: str) -> list:
    """The id, and a hash of the text: null ids and repeated ids have rows of different texts."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("rep"),
            F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("th")]


def exploded(table: DataFrame, key: str, packed: str) -> DataFrame:
    """(key, h): one row per number in the binary column ``packed``."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = batch[1].to_pylist()
            sizes = [len(s) // 8 for s in sets]
            keys = np.repeat(np.asarray(batch[0]), sizes)
            numbers = np.frombuffer(b"".join(sets), dtype=np.int64)
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 18)]),
                                                  pa.array(numbers[at:at + (1 << 18)])], [key, "h"])

    return batches(table.select(key, packed), work, f"{key} long, h long")


def with_partners(found: DataFrame, percent: int) -> DataFrame:
    """(d1, d2, n, rep, th, node): the classes that may link with another, numbered."""
    entries = exploded(found.where("n > 0"), "doc_id", "head")
    twice = entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    shared = entries.join(twice, "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))
    # linked sets share 1 + EXTRA % of the smaller, which has least(n) shingles or more
    smaller = F.expr(f"ceil(n * {percent} / 100)")
    enough = F.col("shared") >= 1 + F.floor(smaller * EXTRA / 100)
    alive = written(found.select("doc_id", "th", "n", "d1", "d2").join(shared, "doc_id").where(enough)
                    .groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "th")).alias("r"))
                    .select("d1", "d2", "n", F.col("r.doc_id").alias("rep"), "r.th"))
    return written(alive.withColumn("node", F.monotonically_increasing_id()))


def sets_of(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, n, shingles): the set of every class, read from its first document."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep, sets = [], []
            for node, d1, d2, doc in zip(batch["node"].to_pylist(), batch["d1"].to_pylist(),
                                         batch["d2"].to_pylist(), as_bytes(batch["text"])):
                found = shingles(doc).tobytes()
                digest = hashlib.blake2b(found, digest_size=16).digest()
                if digest == np.array([d1, d2], dtype=np.int64).tobytes():
                    keep.append(node)
                    sets.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())],
                                             ["node", "shingles"])

    reps = small(classes.select("rep", "th", "d1", "d2", "node"))
    chosen = docs.select(*_row(doc_id, text), F.col(text).alias("text")).join(
        reps, ["rep", "th"]).select("node", "d1", "d2", "text")
    return batches(chosen, work, "node long, shingles binary").dropDuplicates(["node"])


def parity(values: np.ndarray) -> list[int]:
    """One bit for every part: whether it holds an odd number of the shingles."""
    part = (values.view(np.uint64) >> _U(64 - PARTS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=PARTS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def rare_first(sets: DataFrame) -> DataFrame:
    """(node, n, alone, tokens): the shingles that several sets have, rarest first, and how many
    only this set has."""
    entries = exploded(sets, "node", "shingles")
    often = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    tokens = (entries.join(often, "h").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
              .select("node", F.col("x.h").alias("tokens")))
    n = (F.octet_length("shingles") / 8).cast("long")
    joined = sets.select("node", n.alias("n")).join(tokens, "node")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            packed = [np.asarray(row.values.to_numpy(zero_copy_only=False), dtype=np.int64).tobytes()
                      for row in batch["tokens"]]
            alone = [n - len(p) // 8 for n, p in zip(batch["n"].to_pylist(), packed)]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["n"], pa.array(alone, pa.int64()), pa.array(packed, pa.binary())],
                ["node", "n", "alone", "tokens"])

    return batches(joined.select("node", "n", "tokens"), work,
                   "node long, n long, alone long, tokens binary")


def prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, alone, at, indexed, bits): the prefix of every set, without shingles it has alone;
    indexed says whether the place ``at`` is also within the shorter prefix for sets no larger."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            bits = []
            for node, n, alone, tokens in zip(*(batch[c].to_pylist() for c in
                                                ("node", "n", "alone", "tokens"))):
                probe = n - least(n, percent) + 1 - alone
                if probe <= 0:
                    continue
                tokens = np.frombuffer(tokens, dtype=np.int64)
                values = tokens[:probe]
                at = np.arange(alone, alone + len(values))
                index = n + (-2 * percent * n // (100 + percent)) + 1
                every = [np.full(len(at), x) for x in (node, n, alone)]
                for column, x in zip(out, (values, *every, at, at < index)):
                    column.append(x)
                bits += [parity(tokens)] * len(at)
            columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:5]] + [
                    pa.array(columns[5].astype(bool)), pa.array(bits, pa.list_(pa.int64()))],
                ["h", "node", "n", "alone", "at", "indexed", "bits"])

    return batches(ordered, work, "h long, node long, n long, alone long, at long, indexed boolean, "
                                  "bits array<long>")


def _can_link(percent: int) -> Column:
    """Length, positional and suffix filter for x against y, the one no larger."""
    order = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    length = 100 * F.col("ny") >= percent * F.col("nx")
    both = F.col("nx") + F.col("ny")
    most = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))  # this shingle and those behind
    differ = F.col("ux") + F.col("uy")
    for k in range(PARTS // 64):
        differ = differ + F.bit_count(F.col("bx")[k].bitwiseXOR(F.col("by")[k]))
    # overlap = (size - difference) / 2
    return (order & length & ((100 + percent) * most >= percent * both)
            & ((100 + percent) * (both - differ) >= 2 * percent * both))


def _side(entries: DataFrame, name: str, *more: Column) -> DataFrame:
    return entries.select("h", *[F.col(c).alias(short + name) for c, short in
                                 (("node", ""), ("n", "n"), ("alone", "u"), ("at", "a"), ("bits", "b"))],
                          *more)


def verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (x, y) that link."""
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            good = []
            for a, b, size in zip(batch["tokens_x"].to_pylist(), batch["tokens_y"].to_pylist(),
                                  batch["size"].to_pylist()):
                both = len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64),
                                          assume_unique=True))
                good.append((100 + percent) * both >= percent * size)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch["x"].filter(mask), batch["y"].filter(mask)], ["x", "y"])

    sides = small(pairs)
    for end in ("x", "y"):
        sides = sides.join(ordered.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"),
                                          F.col("tokens").alias(f"tokens_{end}")), end)
    sides = sides.select("x", "y", "tokens_x", "tokens_y", (F.col("n_x") + F.col("n_y")).alias("size"))
    return written(batches(sides, work, "x long, y long"))


def _across(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Entries with their component, the (h, c, c2) of different components that meet in a list, and
    how many pairs of sets that makes."""
    tasks = few_tasks(entries.count())
    labelled = written(entries.join(small(labels.withColumnsRenamed({"component": "c"})), "node", "left")
                       .withColumn("c", F.coalesce("c", "node")))
    groups = written(labelled.groupBy("h", "c").agg(
        F.count("*").alias("probes"), F.sum(F.col("indexed").cast("long")).alias("indexed"))
        .coalesce(tasks))
    mixed = groups.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                    F.sum("probes").alias("p"), F.sum("indexed").alias("i"),
                                    F.sum(F.col("probes") * F.col("indexed")).alias("own")).where("lo < hi")
    left = written(mixed.select("h", (F.col("p") * F.col("i") - F.col("own")).alias("pairs"))
                   .coalesce(tasks))
    groups = written(groups.join(small(left.select("h")), "h", "left_semi"))
    return labelled, groups, left.agg(F.sum("pairs")).first()[0] or 0


def _with_leaders(labelled: DataFrame, groups: DataFrame, turn: int, percent: int) -> DataFrame:
    """(x, y): for every set of a mixed list the leaders it shares most lists with, EACH at most. A
    list's leader is a set of the component that has most of the list; the order among those is
    another one each turn, but the same for all lists, so that lists agree on few leaders."""
    biggest = groups.groupBy("h").agg(F.max(F.struct("probes", "c")).alias("g")).select("h", "g.c")
    rank = F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("r"), F.col("node"), F.col("n"))
    leaders = (labelled.join(biggest, ["h", "c"]).groupBy("h", "c").agg(F.min(rank).alias("s"))
               .select("h", F.col("c").alias("cy"), F.col("s.node").alias("leader"),
                       F.col("s.n").alias("ny")))
    met = (labelled.join(leaders, "h").where("c <> cy").groupBy("node", "leader", "n", "ny").agg(
        F.count("*").alias("lists")).where(
        100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")))
    best = Window.partitionBy("node").orderBy(F.desc("lists"), "leader")
    chosen = met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= EACH)
    larger = F.struct("n", "node") > F.struct(F.col("ny").alias("n"), F.col("leader").alias("node"))
    return chosen.select(F.when(larger, F.col("node")).otherwise(F.col("leader")).alias("x"),
                         F.when(larger, F.col("leader")).otherwise(F.col("node")).alias("y"))


def _in_full(labelled: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(x, y): all candidate pairs of different components.

    A list falls into the entries of its largest component and the rest. The two parts meet, and the
    rest meets itself: pairs of one component that are compared there are no more than those that the
    largest component makes with the rest, and the condition of the join leaves them out.

    A pair that shares a shingle among the EARLIER ones before this has met in that one's list, which
    both sides belong to as well, so it is left out here: the first list two sets share is the one
    that counts, and there every filter holds."""
    largest = groups.groupBy("h").agg(F.max(F.struct("probes", "c")).alias("g")).select(
        "h", F.col("g.c").alias("largest"))
    before = Window.partitionBy("node").orderBy("at").rowsBetween(-EARLIER, -1)
    mixed = written(labelled.join(small(written(largest)), "h")
                    .withColumn("part", F.col("c") == F.col("largest")).drop("largest")
                    .withColumn("earlier", F.collect_list("h").over(before)))
    meets = F.explode(F.when(F.col("part"), F.array(F.lit(False)))
                      .otherwise(F.array(F.lit(False), F.lit(True)))).alias("part")
    ours = _side(mixed, "x", F.col("c").alias("cx"), F.col("earlier").alias("ex"), meets)
    theirs = _side(mixed.where("indexed"), "y", F.col("c").alias("cy"), F.col("earlier").alias("ey"),
                   F.col("part"))
    return (ours.join(theirs, ["h", "part"])
            .where((F.col("cx") != F.col("cy")) & _can_link(percent) & ~F.arrays_overlap("ex", "ey"))
            .select("x", "y"))


def links(docs: DataFrame, classes: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """(node, component) of the classes that link with another."""
    sets = written(sets_of(docs, classes, doc_id, text))
    ordered = written(rare_first(sets))
    entries = written(prefixes(ordered, percent))
    free_shuffles(docs)
    n_entries, found, done, turn, before = entries.count(), None, None, 0, None
    labels = entries.select("node", F.col("node").alias("component")).limit(0)
    while True:
        labelled, groups, left = _across(entries, labels)
        if not left:
            break
        last = left <= WORTH * n_entries or (before is not None and 2 * left > before)
        pairs = (_in_full(labelled, groups, percent) if last
                 else _with_leaders(labelled, groups, turn, percent)).distinct()
        pairs = pairs if done is None else pairs.join(small(done), ["x", "y"], "left_anti")
        pairs = written(pairs.coalesce(few_tasks(n_entries)))
        fresh = verified(pairs, ordered, percent)
        found = fresh if found is None else found.union(fresh)
        done = pairs if done is None else done.union(pairs)
        labels = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
        free_shuffles(docs)
        if last:
            break
        turn, before = turn + 1, left
    return labels


def classes_of(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document; component_id is the smallest id that
    links reach."""
    found = written(signatures(docs, percent, doc_id, text), "uncompressed")
    classes = with_partners(found, percent)
    free_shuffles(docs)
    labels = links(docs, classes, percent, doc_id, text)
    joined = classes.join(labels, "node").select("d1", "d2", "rep", "component")
    lowest = joined.groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = written(joined.join(lowest, "component").select("d1", "d2", "lowest"))
    own = found.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("own"))
    of_class = own.join(linked, ["d1", "d2"], "left").select(
        "d1", "d2", F.least("own", "lowest").alias("component_id"))
    out = found.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    return out.select(
        F.expr(f"nullif(doc_id, {_NONE})").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.expr(f"nullif(if(n = 0, doc_id, component_id), {_NONE})").alias("component_id"))
