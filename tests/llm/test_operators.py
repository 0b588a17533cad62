"""Every operator against a plain version of it, on small frames with all the odd cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crowdcover.llm import (bpe, chat, common, exact_dedup, jaccard_join, line_dedup, packing,
                            quality_rules, toxicity, training_order, url_filter, words)
from crowdcover.llm.perfect_hash import PerfectHash, keys_of
from crowdcover.llm.queries import BYTE_RANKS, OP3, TRAIN, WORD_TOKENIZER, op3_quality_rules
from crowdcover.llm.words import WordEncoder, word_encoder
from oracle import compare

WORDS = "the of and a to in is it that was for on are with as at be this have from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def odd_docs():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 60, 200, 800)]
    rows = [(0, None, "a"), (1, "", "a"), (2, "   \n\t", None), (3, "one", "b"), (3, "one", "b"),
            (None, base[2], "a"), (4, base[2], "b"), (5, base[2] + " end", None),
            (6, base[2].upper(), "a"), (7, prose(rng, 30_000), "c"), (8, "a a a a a a a a", "c"),
            (9, "x\n" * 40, "c"), (10, "ß İ Σ é\u0301 日本 \x85 \x1c <|endoftext|> it's. , .", "c"),
            (11, base[3], "b"), (12, base[3] + "\n" + base[1], "a"), (4, base[3] + " other id", "a")]
    for k in range(30):
        words = base[3].split()
        words[rng.randrange(len(words))] = f"new{k}"
        rows.append((100 + k, " ".join(words), f"h{k % 3}"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_docs()
    return spark.createDataFrame(
        [(*r, "x", 1, 2, "y", 5) for r in rows],
        "doc_id long, text string, source string, kept string, n long, h long, digest string, node int"
    ).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# perfect hash

@given(st.sets(st.binary(min_size=1, max_size=20), max_size=300))
@settings(max_examples=40, deadline=None)
def test_perfect_hash_is_minimal_and_perfect(values):
    digests = [hashlib.md5(v).digest() for v in values]
    keys = keys_of(digests)
    table = PerfectHash.build(keys)
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    assert (PerfectHash.unpacked(table.packed()).find(keys) == table.find(keys)).all()


# 1 URL filter

URLS = ["http://a.b.net/en/1", "https://X.Example.NET/en/9?q", "https://x.example.net/de/", "net/a",
        "http://example.com/de", "http://example.com/de/1#f", "http://m.example.com/de/", "ftp://fr.org/fr/",
        "http://org/fr/x", "http://borg/fr/", None, "", "://", "http://", "http://a.net?x://b.org/fr/",
        "http://other.io/p/", "http://other.io/p", "http://other.io/pq", "a\n://EXAMPLE.com/de/\nx"]


def plain_judge(url, rules, listed):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        rest = rest[end:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if host and (host, path.rstrip("/")) in listed else "allow"


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"), ("io", "/never", "block")]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(URLS + URLS[:4])],
                                  "page_id int, url string, rule string, key int")
    listed = spark.createDataFrame([("http://other.io/p", "block"), (None, "block"), ("x", "block")],
                                   "url string, verdict string")
    out = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"),
                           listed)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: plain_judge(u, rules, {("other.io", "/p")}) for i, u in enumerate(URLS + URLS[:4])}
    none = rules[:0]
    blank = spark.createDataFrame(none, "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judge(pages, blank, listed.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), blank, listed).count() == 0


def test_bloom_filter_never_misses():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    table = np.zeros((512, 8), dtype=np.uint32)
    block, words = url_filter._spots(keys, 512)
    for b, w in zip(block.astype(int), words):
        table[b] |= w
    assert url_filter.may_hold(table, keys).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 20000)
    assert url_filter.may_hold(table, other).mean() < 0.01


# 2 training order

@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
@settings(max_examples=30, deadline=None)
def test_permutation(n, key):
    order = training_order.Permutation(n, key)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.numbers(slots) == np.arange(n)).all()


@lru_cache(None)
def word_tokenizer():
    return Tokenizer.from_file(WORD_TOKENIZER)


def word_ids(text):
    return word_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_training_order(spark, docs, empty):
    layout, index = training_order.materialise(docs, WORD_TOKENIZER, key=5, length=256, shard=16)
    rows = {r["slot"]: r for r in index.collect()}
    n = layout.sequences
    assert sorted(rows) == list(range(n)) and sorted(r["number"] for r in rows.values()) == list(range(n))
    order = training_order.Permutation(n, 5)
    read = list(training_order.read_slots(layout.folder, 0, n))
    again = {r["slot"]: r["ids"] for r in training_order.read_records(spark, layout).collect()}
    stream = []
    for number in range(n):
        slot = int(order.slots([number])[0])
        row = rows[slot]
        assert row["number"] == number and row["shard"] == slot // 16
        assert row["at_byte"] == slot % 16 * 512 and len(read[slot]) == 256
        assert again[slot] == read[slot].tobytes()
        size = sum(row["lengths"])
        assert size == 256 or number == n - 1
        assert zlib.crc32(read[slot][:size].tobytes()) == row["ids_crc32"]
        assert (read[slot][size:] == 2).all()
        stream += zip(row["doc_ids"], row["starts"], row["lengths"],
                      np.split(read[slot][:size], np.cumsum(row["lengths"])[:-1]))
    found, open_ = Counter(), []
    for doc_id, start, _, ids in stream:
        open_ = open_ + ids.tolist() if start else ids.tolist()
        if open_[-1] == 2:
            found[doc_id, tuple(open_)] += 1
            open_ = []
    assert found == Counter((r[0], (*word_ids(r[1]), 2)) for r in odd_docs())
    part = list(training_order.read_slots(layout.folder, 5, 40))
    assert all((a == b).all() for a, b in zip(part, read[5:40])) and len(part) == 35
    layout, index = training_order.materialise(empty, WORD_TOKENIZER, key=5)
    assert layout.sequences == 0 and index.count() == 0


# 3 quality rules

def plain_measures(text):
    import re
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered)), len(lines)


def test_quality_rules(spark, docs, empty):
    rows = [(i, r[1], "junk" if i % 2 else r[2]) for i, r in enumerate(odd_docs())]
    rows += [(1000 + i, "# * bad " * (i + 1), "junk") for i in range(40)]
    rows += [(2000 + i, "a b c\x0bd e a b c d a b c " * i + "ä#\n\nä#\n", "h") for i in range(9)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    failed, n = Counter(), Counter()
    for doc_id, text, host in rows:
        m, n_lines = plain_measures(text)
        r = got[doc_id]
        assert tuple(r[c] for c in quality_rules.MEASURES) == m, doc_id
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        if host is not None:
            n[host] += 1
            for rule, bad in zip(quality_rules.RULES, (m[0] < 50, 100 * m[4] > 50 * m[0], 100 * m[2] > 10 * m[1],
                                                       100 * m[3] > 30 * n_lines)):
                failed[host, rule] += bad
    rejected = {}
    for rule in quality_rules.RULES:
        share, weight = quality_rules.prior(
            len(n), sum(n.values()), sum(failed[h, rule] for h in n),
            sum(failed[h, rule] ** 2 / n[h] for h in n), sum(k * k for k in n.values()))
        for h in n:
            mean = (failed[h, rule] + share * weight) / (n[h] + weight)
            if mean - 2 * (mean * (1 - mean) / (n[h] + weight + 1)) ** 0.5 > 0.3:
                rejected.setdefault(h, []).append(rule)
    assert "symbols" in rejected["junk"] and len(rejected) < len(n)
    for doc_id, _, host in rows:
        assert got[doc_id]["host_rules"] == (None if host is None else rejected.get(host, []))
    for doc_id, _, host in rows:
        assert got[doc_id]["kept"] == (not got[doc_id]["base_failed"] and host not in rejected)
    assert quality_rules.judge(docs).columns[:3] == ["doc_id", "text", "source"]
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.judge(docs, carry=["doc_id"]).count() == len(odd_docs())


def test_bad_hosts_lose_all_documents(spark, tmp_path):
    """Documents of a given table on planted hosts that fail one rule each: these hosts go as a whole, and a
    host of two such documents, one with a tenth of them and all others stay; the SQL says the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.col("doc_id") % 20
    odd = (F.floor(F.col("doc_id") / 20) % 10)
    symbols, lines = F.concat(F.lit(" "), F.repeat(F.lit("#|<>"), 9000)), F.repeat(F.lit("\nx"), 60)
    bad = (docs.withColumn("source", F.when(part == 1, "symbols.example").when(part == 2, "lines.example")
                           .when(part == 3, "tenth.example").when(F.col("doc_id") == 24, "tiny.example")
                           .otherwise(F.col("source")))
           .withColumn("text", F.when((part == 1) & (odd < 8), F.concat("text", symbols))
                       .when((part == 2) & (odd < 8), F.concat("text", lines))
                       .when((part == 3) & (odd < 1), F.concat("text", symbols))
                       .when(F.col("doc_id") == 24, F.concat("text", symbols)).otherwise(F.col("text"))))
    folder = str(tmp_path)
    bad.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    verdict, n, info = compare(spark, con, folder, op3_quality_rules, OP3)
    assert verdict == "ok" and n == docs.count(), info
    out = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet"), carry=["doc_id"])
    hosts = {r["source"]: r for r in out.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"),
        F.sum((~F.col("base_failed")).cast("int")).alias("passed"), F.any_value("host_rules").alias("rules")).collect()}
    assert hosts["symbols.example"]["rules"] == ["symbols"] and hosts["lines.example"]["rules"][-1:] == ["dup_lines"]
    for name, r in hosts.items():
        gone = name in ("symbols.example", "lines.example")
        assert r["passed"] > 0 or name == "tiny.example"
        assert r["kept"] == (0 if gone else r["passed"]), name


def test_prior_shrinks_small_hosts():
    # hosts that differ: a weak prior; hosts that don't: a strong one
    differ = quality_rules.prior(2, 200, 100, 100 ** 2 / 100, 2 * 100 ** 2)
    alike = quality_rules.prior(2, 200, 100, 2 * 50 ** 2 / 100, 2 * 100 ** 2)
    assert differ[0] == alike[0] == 0.5 and differ[1] < 1 < alike[1] == quality_rules.DEFAULT_WEIGHT
    assert quality_rules.prior(0, 0, 0, 0.0, 0.0)[1] == quality_rules.DEFAULT_WEIGHT


# 4 Jaccard join

def plain_sets(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ")
    words = [w for w in words.encode().split()]
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain_components(rows, percent=80):
    sets = [plain_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        key = -math.inf if d is None else d
        low[root(i)] = min(low.get(root(i), math.inf), key)
    return Counter((d, len(s), None if low[root(i)] == -math.inf else low[root(i)])
                   for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, groups, size, length, edits):
    """Chains and clouds of near copies around the threshold, with shared passages."""
    passage = prose(rng, 40)
    rows = []
    for g in range(groups):
        words = prose(rng, length).split()
        if g % 2:
            words[10:10] = passage.split()
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(50)}"
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                words = copy
    rng.shuffle(rows)
    return list(enumerate(rows))


def jaccard_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return Counter(map(tuple, jaccard_join.classes_of(frame).collect()))


def test_jaccard_join_odd_cases(spark, docs, empty):
    got = Counter(map(tuple, jaccard_join.classes_of(docs).collect()))
    assert got == plain_components([(r[0], r[1]) for r in odd_docs()])
    assert jaccard_join.classes_of(empty).count() == 0


@pytest.mark.parametrize("seed, worth", [(1, 8), (2, 0), (3, 0)])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, worth):
    monkeypatch.setattr(jaccard_join, "WORTH", worth)  # 0: rounds of leaders as in a large group
    rng = random.Random(seed)
    rows = near_copies(rng, 10, 12, rng.choice([30, 90]), 6)
    assert jaccard_rows(spark, rows) == plain_components(rows)


def test_filters_lose_no_link():
    rng = random.Random(5)
    for _ in range(300):
        common_part = {rng.randrange(10**6) for _ in range(rng.randrange(1, 60))}
        x = common_part | {rng.randrange(10**6) for _ in range(rng.randrange(8))}
        y = common_part | {rng.randrange(10**6) for _ in range(rng.randrange(8))}
        if len(x) < len(y):
            x, y = y, x
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        order = {v: i for i, v in enumerate(rng.sample(sorted(x | y), len(x | y)))}
        a, b = sorted(x, key=order.get), sorted(y, key=order.get)
        first = next(v for v in a if v in y)
        i, j = a.index(first), b.index(first)
        assert i < len(a) - jaccard_join.least(len(a), 80) + 1
        assert j < len(b) + (-160 * len(b) // 180) + 1
        assert 180 * min(len(a) - i, len(b) - j) >= 80 * (len(a) + len(b))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, common.components(frame).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in (1000, 1001, 1002)}}
    assert common.components(frame.limit(0)).count() == 0


# 5 line dedup

def plain_line_dedup(rows):
    """rows: (doc_id, text), distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[doc_id] = (None, 0)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out[doc_id] = ("\n".join(kept), len(gone)) if gone else (text, 0)
    return out


def test_line_dedup(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a\nb"), (None, "q\nq\nq\nq\nq"), (903, "\n" * 9),
             (904, "\n".join(str(i) for i in range(5000))),
             (905, "\n".join(str(i) for i in range(4000, 6000)))]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == plain_line_dedup(rows)
    assert line_dedup.dedup(empty).count() == 0
    same = line_dedup.dedup(docs)
    assert same.count() == len(odd_docs()) and same.columns == [*docs.columns, "n_removed"]


def test_line_dedup_repeated_rows(spark):
    text = "a\nb\nc\nd"
    out = line_dedup.dedup(spark.createDataFrame([(1, text), (1, text), (2, "x\n" + text)],
                                                 "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, "", 4), (1, text, 0), (2, "x", 4)]
    out = line_dedup.dedup(spark.createDataFrame([(None, text)] * 3 + [(0, text + "\ne")], "doc_id long, text string")
                           .repartition(4))
    assert sorted((r[1], r[2]) for r in out.collect()) == [("", 4), ("", 4), ("a\nb\nc\nd", 0), ("d\ne"[2:], 4)] or \
        sorted((r[1], r[2]) for r in out.collect()) == [("", 4), ("", 4), ("a\nb\nc\nd", 0), ("c\nd\ne", 2)]


# 6 toxicity

def brute_maximal(scores):
    """Maximal segments by their definition: no proper part on either side pushes the sum down, and
    none of a larger segment with the same property."""
    n, total = len(scores), np.concatenate([[0.0], np.cumsum(scores)])

    def good(i, j):  # every proper prefix and suffix is positive
        return all(total[k] > total[i] + 1e-12 for k in range(i + 1, j + 1)) and all(
            total[j] > total[k] + 1e-12 for k in range(i, j))

    found = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if good(i, j)]
    return sorted((i, j) for i, j in found
                  if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in found))


@given(st.lists(st.sampled_from([0, 0, 0, 1.5, 2.25, 4.125]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(raw):
    values = np.array(raw, dtype=float)
    at = np.flatnonzero(values)
    got = toxicity.maximal_segments(at, values[at], -0.8125)
    scores = np.where(values == 0, -0.8125, values)
    assert [(s, e) for s, e, _ in got] == brute_maximal(scores)
    assert all(math.isclose(x, scores[s:e].sum()) for s, e, x in got)


def toxic_corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randrange(30, 300)).split(), rng.random() < 0.15
        if bad:
            at = rng.randrange(len(words) - 20)
            for k in range(at, at + 20, 4):
                words[k] = rng.choice(["vileword", "meanthing", "slurry"]) + rng.choice(["", "s", "er,"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows, labels = toxic_corpus(random.Random(4), 600)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known, F.expr(TRAIN))
    out = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["predicted"] == y for i, y in held) and len(held) > 80
    for i, y in labels:
        assert 0 <= out[i]["score"] <= 1 and bool(out[i]["passages"]) == bool(y)
        for p in out[i]["passages"]:
            words = rows[i][1].split()[p["start"]:p["end"]]
            assert words[0][:4] in ("vile", "mean", "slur") and words[-1][:4] in ("vile", "mean", "slur")
    odd = toxicity.score(docs, model)
    assert odd.count() == len(odd_docs())
    assert odd.where("score IS NULL OR score < 0 OR score > 1 OR predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_every_toxic_passage_is_found(spark):
    rows, labels = toxic_corpus(random.Random(4), 600)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.expr(TRAIN))
    rng, bad = random.Random(5), ["vileword", "meanthing", "slurry"]

    def clean(n):
        out = []
        while len(out) < n:
            out += prose(rng, 60).split()
        return out[:n]

    passage = [w for k in range(5) for w in (bad[k % 3], *clean(3))][:17]
    texts = {"twice": clean(100) + passage + clean(1000) + passage + clean(100),
             "late": [w for b in bad for w in (b, *clean(1000))] + passage + clean(100)}
    asked = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id string, text string")
    found = {r["id"]: [(p["start"], p["end"]) for p in r["passages"]]
             for r in toxicity.score(asked, model).collect()}
    late = len(texts["late"]) - 117
    assert found["twice"] == [(100, 117), (1117, 1134)]
    assert (late, late + 17) in found["late"]  # single words on the way may be passages, too


def test_repeats_are_damped_by_distance():
    at = np.array([0, 1, 2, 500, 501, 10**6])
    numbers = np.array([7, 9, 7, 7, 7, 9])
    places, scores = toxicity.damped(numbers, at, np.full(6, 4.0), -0.01)
    got = dict(zip(places.tolist(), scores.tolist()))
    assert got[0] == got[1] == 4.0 and math.isclose(got[10**6], 4.0)
    assert 0 < got[2] < 0.5 and 0 < got[501] < 0.5 and got[500] > 3.9
    assert not len(toxicity.damped(numbers[:0], at[:0], np.empty(0), -0.01)[0])


def test_toxic_words_that_begin_like_clean_ones(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(600):
        words, bad = prose(rng, rng.randrange(60, 200)).split(), rng.random() < 0.15
        at = rng.randrange(len(words) - 20)
        for k in range(at, at + 20, 4):  # 8 and 5 letters are shared with a common clean word
            words[k] = rng.choice(["fachlichpfui", "fachkeiter"] if bad else ["fachlich", "fachkraft"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.expr(TRAIN))
    out = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(y for _, y in held) > 10 and all(out[i]["predicted"] == y for i, y in held)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, F.expr(TRAIN))
    assert not len(model.stems)
    assert toxicity.score(docs, model).select("score").where("score IS NULL").count() == 0


# 7 packing

@given(st.integers(1, 40_000), st.sampled_from([64, 100, 4096]))
@settings(max_examples=200, deadline=None)
def test_cuts(n, capacity):
    out = packing.cuts(n, capacity)
    assert sum(out) == n and all(0 < x <= capacity for x in out)
    assert len(out) <= n // capacity + 6


def check_packing(rows, docs, capacity, padding=None):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter()
    for doc_id, text in docs:
        want[doc_id] += len(word_ids(text)) + 1
    assert {d: sum(r["length"] for r in p) for d, p in pieces.items()} == want
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(np.array([*word_ids(text), 2], dtype="<u4"))
    for d, p in pieces.items():
        if len(texts[d]) == 1:
            at = 0
            for r in sorted(p, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(texts[d][0])
                assert r["ids_crc32"] == zlib.crc32(texts[d][0][at:at + r["length"]].tobytes())
                at += r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    lost = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        lost += 0 if at & (at - 1) == 0 else capacity - at
    if padding is not None:
        assert lost <= padding * sum(want.values())
    return lost


def test_packing(spark, docs, empty):
    plain = [(r[0], r[1]) for r in odd_docs()]
    check_packing(packing.pack(docs, WORD_TOKENIZER).collect(), plain, 4096)
    check_packing(packing.pack(docs, WORD_TOKENIZER, capacity=100).collect(), plain, 100)
    assert packing.pack(empty, WORD_TOKENIZER).count() == 0


def test_packing_pads_little(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(folder)
    rows = packing.pack(docs.repartition(5), WORD_TOKENIZER).collect()
    check_packing(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 4096, 0.02)


def test_leftover_is_bounded():
    assert packing.leftover_bound(4096) < 30_000


# words and byte-level BPE

TEXTS = [r[1] or "" for r in odd_docs()] + [
    "  a  b ", "It's a TEST, isn't it... ok?!", "x,y.z", "a b\x85c\x1cd", "\tA\r\nB\x0bC\x0c", "'S 'LL",
    "..., a.b,c ,d .e", " " * 10, "\x00 a\x00b", "a\n b", "a \nb", "x\n\ny", "trailing. ", ".", " ,",
    "12345 a1b2 ½ ²", "naïve café.Élan,", "\U0001f600 \ud7ff z", "don't,can't.", "a" * 5000]


@lru_cache(None)
def reference_encoding():
    with open(BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_word_encoder():
    encoder = word_encoder(WORD_TOKENIZER)
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == word_ids(text), text[:40]


@given(st.text(alphabet=st.sampled_from(" \n\t.,'aBsé日1\x85²ſİ\u0301"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_encoders_on_any_text(text):
    assert np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4").tolist() == word_ids(text)
    codec = bpe.codec(BYTE_RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(codec.encode([text])[0], np.int32)
    assert ids.tolist() == reference_encoding().encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_columns(spark, docs, empty):
    encoding = reference_encoding()
    frame = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id int, text string")
    ids = bpe.encode(frame, "text", BYTE_RANKS, public_tokenizers.PATTERN)
    out = bpe.decode(ids, "ids", BYTE_RANKS, public_tokenizers.PATTERN)
    for r in out.withColumn("sha", bpe.sha256_of_ids("ids")).collect():
        want = encoding.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and bytes(r["bytes"]) == (r["text"] or "").encode()
        assert r["sha"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(docs, "text", BYTE_RANKS, public_tokenizers.PATTERN, out="node").count() == 46
    assert bpe.encode(empty, "text", BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_chunks_are_not_remembered():
    encoder = WordEncoder(WORD_TOKENIZER)
    long = [base64.b64encode(bytes(range(k, k + 90))).decode() for k in range(9)] + ["語" * 500, "x" * 41]
    for text in [*long, " ".join(long) + " short", "y" * 40]:
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == word_ids(text)
    assert max(map(len, encoder.known.now)) == 40


def test_texts_encoded_together(monkeypatch):
    """Blocks of texts give what every text gives alone; special tokens in capitals are no special tokens."""
    monkeypatch.setattr(words, "TOGETHER", 50)
    monkeypatch.setattr(words, "AT_ONCE", 3)
    rng = random.Random(6)
    signs = [*"aAbZ019'’.,;- \n\t\x0b\x85\xa0éÉßİıς日本\u0301½Ⅷ<|", "'s", " the ", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a <|ENDOFTEXT|> B", "", " ", "x" * 200, "long " * 5000]
    encoder = WordEncoder(WORD_TOKENIZER)
    encoder.known.room = 100
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == word_ids(text), text[:80]
    assert len(encoder.known.now) <= 100 and list(encoder.encode_all([])) == []


def test_no_remembering_is_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(BYTE_RANKS, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert np.frombuffer(codec.encode([text])[0], np.int32).tolist() == (
            reference_encoding().encode_ordinary(text))
    assert len(codec.known) <= 3


# 8 exact dedup

@pytest.mark.parametrize("history", ["doc_id < 50", "doc_id < 0", "true", "cast(null as boolean)"])
def test_exact_dedup(spark, docs, empty, monkeypatch, history):
    monkeypatch.setattr(exact_dedup, "BUCKET", 4)
    out = exact_dedup.dedup(docs, F.expr(history))
    rows = odd_docs()
    groups, known = defaultdict(list), set()
    for d, t, _ in rows:
        groups[t or ""].append(d)
        if history == "true" or (d is not None and history == "doc_id < 50" and d < 50):
            known.add(t or "")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"], r["known"])
                  for r in out.collect())
    want = Counter()
    for d, t, _ in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want[d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest(),
             (t or "") in known] += 1
    assert got == want
    assert exact_dedup.dedup(empty, F.expr(history)).count() == 0


@pytest.mark.parametrize("old", [0, 3])
def test_buckets_follow_new_digests_too(spark, monkeypatch, old):
    monkeypatch.setattr(exact_dedup, "BUCKET", 16)
    made, plain = [], exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda index, new, buckets: (
        made.append(buckets), plain(index, new, buckets))[1])
    frame = spark.createDataFrame([(i, f"t{i // 2}") for i in range(400)], "doc_id long, text string")
    out = exact_dedup.dedup(frame.repartition(2), F.col("doc_id") < old).collect()
    assert 200 / 16 <= made[0] <= 400 / 16 + 1
    assert all((r["keep_id"], r["group_size"]) == (r["doc_id"] | 1, 2) for r in out) and len(out) == 400


# 10 chat

SAYINGS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", "\\-\\n\\\\", "", "<", "<|im_",
           "a\\<|im_end|>", "\n\n", "<\\-|im_end|>", "[\\-INST]", "日本<|user|>", "<<SYS>>"]


@pytest.mark.parametrize("role", ["user", "assistant", "a\nb", "\\n\\", "<|im_end|>", ""])
def test_chat_round_trip(spark, role):
    turns = [(role, s) for s in SAYINGS] + [("assistant", s) for s in SAYINGS]
    frame = spark.createDataFrame([(1, turns), (2, []), (3, None)],
                                  "id int, turns array<struct<role:string,text:string>>")
    out = chat.formatted(frame)
    rows = {r["id"]: r for r in out.withColumns({
        "back": chat.read_turns(F.col("formatted")),
        "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))}).collect()}
    assert [tuple(t) for t in rows[1]["back"]] == turns
    assert rows[1]["loss"] == "".join(s for r, s in turns if r == "assistant")
    assert rows[1]["formatted"].count(chat.END) == len(turns)
    body = rows[1]["formatted"].replace(chat.START, "").replace(chat.END, "")
    assert not any(c in body for c in chat.CONTROL)
    assert rows[2]["formatted"] == "" and rows[2]["back"] == [] and rows[3]["formatted"] is None


def test_layouts(spark):
    records = {
        '{"id":1,"messages":[{"role":"user","content":"x"},{"content":null,"role":"assistant"}]}':
            ("messages", [("user", "x"), ("assistant", "")]),
        '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}],"id":"s"}':
            ("turns", [("user", "x"), ("assistant", "y")]),
        '{"id":7,"dialog":{"turns":[{"text":"t","speaker":{"role":"system"}}]}}':
            ("nested", [("system", "t")]),
        '{"response":"b","prompt":"a","id":2}': ("prompt", [("user", "a"), ("assistant", "b")]),
        '{"id":2,"system":"s","instruction":"i","output":null}':
            ("instruction", [("system", "s"), ("user", "i"), ("assistant", "")]),
        '{"instruction":"i","input":"","output":"o"}': ("alpaca", [("user", "i"), ("assistant", "o")]),
        '{"instruction":"i","input":"z","output":"o"}':
            ("alpaca", [("user", "i"), ("user", "z"), ("assistant", "o")]),
        '{"prompt":"a"}': (None, None), "not json": (None, None), "": (None, None),
    }
    frame = spark.createDataFrame([(r, "x") for r in [*records, None]], "record string, chat string")
    for r in chat.canonical_turns(frame).collect():
        layout, turns = records.get(r["record"], (None, None))
        assert r["layout"] == layout, r["record"]
        assert r["turns"] is None if turns is None else [tuple(t) for t in r["turns"]] == turns
    assert chat.canonical_turns(frame.limit(0)).count() == 0


LONG_TEXT = "a\\ \"b\n\tü😀\u0001\ue000q/" + "word " * 5_000_000


def test_long_conversations_are_whole(spark):
    """Beyond what JSON functions read: 25 million characters, in every kind of layout."""
    records = spark.range(3).select("id", F.lit(LONG_TEXT[:30]).alias("head"), F.lit("word ").alias("w"))
    text = F.concat("head", F.repeat("w", 5_000_000))
    records = records.select("id", F.when(F.col("id") == 0, F.to_json(F.struct(
        F.lit(1).alias("id"), F.lit("q").alias("prompt"), text.alias("response")))).when(
        F.col("id") == 1, F.to_json(F.struct(F.lit(1).alias("id"), F.array(
            F.struct(F.lit("user").alias("role"), text.alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.lit("yes").alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.lit(1).alias("id"), F.struct(F.array(
            F.struct(F.struct(F.lit("user").alias("role")).alias("speaker"), text.alias("text"))).alias("turns"))
            .alias("dialog")))).alias("record"))
    out = chat.canonical_turns(records).select("id", "layout", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.length(t["text"]).alias("n"), F.sha2(t["text"], 256).alias("sha"))).alias("t"))
    long = LONG_TEXT[:30] + "word " * 5_000_000
    sha = hashlib.sha256(long.encode()).hexdigest()
    got = {r.id: (r.layout, [(t.role, t.n, t.sha) for t in r.t]) for r in out.collect()}
    short = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("q", "yes")}
    assert got == {0: ("prompt", [("user", 1, short["q"]), ("assistant", len(long), sha)]),
                   1: ("messages", [("user", len(long), sha), ("assistant", 3, short["yes"])]),
                   2: ("nested", [("user", len(long), sha)])}


def test_long_and_short_records_read_alike(spark, monkeypatch):
    texts = ["", "plain", 'q"uo\\te', "\\", "\\\\n", "\n\t\r\b\f/", "\ue000", "\ue000q \ue000\ue000s", "ü😀\u0001\u001f",
             ': "x":', "a" * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string")
    records = frame.select("i", F.to_json(F.struct(F.lit(1).alias("id"), F.array(
        F.struct(F.lit("human").alias("from"), F.col("t").alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.concat("t", F.lit("!")).alias("value"))).alias("conversations"))).alias("record"))
    plain = {r.i: [tuple(t) for t in r.turns] for r in chat.canonical_turns(records).collect()}
    monkeypatch.setattr(chat, "LONG", 5)
    again = {r.i: [tuple(t) for t in r.turns] for r in chat.canonical_turns(records).collect()}
    assert again == plain == {i: [("user", t), ("assistant", t + "!")] for i, t in rows}


def test_own_columns_keep_their_names(spark):
    frame = spark.createDataFrame([(1, "a b c " * 30, "h", "mine", "mine", 7.0)],
                                  "doc_id long, text string, source string, rejected string, failed string, segments double")
    one = quality_rules.judge(frame).first()
    assert (one.rejected, one.failed, one.segments) == ("mine", "mine", 7.0)
    turns = spark.createDataFrame([("mine", [("user", "t")])], "chat string, turns array<struct<role:string,text:string>>")
    assert chat.formatted(turns).first().chat == "mine"


def test_null_ids_are_rows_of_their_own(spark):
    """No join multiplies rows without an id."""
    rng = random.Random(12)
    texts = [prose(rng, 40) for _ in range(60)]
    rows = [(None, t) for t in texts] + [(None, t + " end") for t in texts]
    out = jaccard_join.classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 120 and {r.component_id for r in out} == {None}
    found = jaccard_join.written(jaccard_join.signatures(
        spark.createDataFrame(rows, "doc_id long, text string"), 80, "doc_id", "text"))
    classes = jaccard_join.with_partners(found, 80)
    assert jaccard_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), classes, "doc_id",
                                "text").count() == classes.count() == 120
