"""Filter audit, token alignment and archives against plain versions, with all the odd cases."""

import bisect
import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crowdcover.llm import align, filter_audit, warc
from crowdcover.llm.queries import BYTE_TOKENIZER, PIECE_MODEL
from crowdcover.llm.words import Recent
from test_operators import odd_docs, prose


# what workers remember

def test_memory_forgets_what_is_not_met():
    recent = Recent(room=2)
    for words in (["a", "b", "c"], ["a", "d"], ["e", "f", "g"], ["a"]):
        new = recent.missing([words])
        got = {c: c * 2 for c in new}
        assert recent.of(words, got) == [c * 2 for c in words]
        recent.add(got)
    recent = Recent(room=3)
    made = []
    for c in "abcabcdabca" + "efghijk" + "a":
        new = recent.missing([[c]])
        made += new
        recent.add({x: x for x in new})
    assert made.count("a") == 2 and made.count("b") == 1  # forgotten once, not while in use
    assert len(recent.now) <= 3 and len(recent.older) <= 4


# 11 filter audit

def plain_failures(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text
                                            for d, t, _ in rows)}


def plain_audit(rows, labels):
    """(part, order, step) -> counts, order by order and document by document."""
    out = {}
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    fails = [plain_failures(d, t, rows) for d, t, _ in rows]
    for part in {p or "" for _, _, p in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                before = set(mine) - set(left)
                left = [i for i in left if not fails[i][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails[i][f] for i in before),
                    sum(fails[i][f] and sum(fails[i].values()) == 1 for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(d, t, s) for d, t, s in odd_docs()]
    rows += [(200, long, "a"), (201, long, "b"), (None, long, "b"), (202, long + " #", "a"),
             (203, long.upper(), None), (204, "x " * 300, ""), (205, "É" * 11 + "A", "a"),
             (205, long, "a"), (206, "A\x85B c\x1cd", "c"), (200, long, "c"), (207, "$" * 1000, "a")]
    rows += [(300 + k, prose(rng, rng.randrange(150)), rng.choice("abc")) for k in range(40)]
    return rows


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(200, 1, 0), (201, 0, 1), (201, 1, 1), (None, 1, 1), (4, 1, 1), (305, 1, None), (306, None, 1),
              (9999, 1, 1), (207, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "z", "q", 1) for r in rows],
                                 "doc_id long, text string, lang string, n long, mask string, part string, "
                                 "first int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit_documents(docs, marks, F.col("lang"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in out.collect()}
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.audit_documents(docs.limit(0), marks, F.col("lang")).count() == 0
    none = filter_audit.audit_documents(docs, marks.limit(0), F.lit(None))
    assert {(r["part"], r["good_lost"], r["toxic_lost"]) for r in none.collect()} == {("", 0, 0)}


@given(st.integers(1, 5), st.lists(st.integers(0, 31), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_removal_ranks(n, masks):
    masks = np.array([m % (1 << n) for m in masks])
    orders = np.array(list(permutations(range(n))))
    ranks = filter_audit.removal_ranks(masks, orders)
    for m, row in zip(masks, ranks):
        for o, rank in zip(orders, row):
            assert rank == next((k for k, f in enumerate(o, 1) if m >> f & 1), 0)


@given(st.text(alphabet=st.sampled_from("aAbZ #$|\t\n\x0b\x85\x1cé日 "), max_size=300))
@settings(max_examples=200, deadline=None)
def test_text_failures(text):
    want = plain_failures(0, text, [])
    got = filter_audit.text_failures(text.encode())
    assert [bool(got >> i & 1) for i in range(4)] == [want[f] for f in "ABCD"]


def test_audit_takes_other_filters(spark):
    counted = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 1, 2, 1, 0), ("p", 3, 4, 0, 4)],
                                    "part string, mask int, n long, good long, toxic long")
    got = {tuple(r)[1:] for r in filter_audit.audit(counted, "xy").collect()}
    assert got == {("xy", 1, 5, 6, 0, 2, 1, 4, 8), ("xy", 2, 5, 0, 4, 0, 0, 0, 4),
                   ("yx", 1, 7, 4, 0, 0, 0, 4, 4), ("yx", 2, 5, 2, 4, 2, 1, 0, 8)}
    with pytest.raises(ValueError):
        filter_audit.audit(counted, "abcdefgh")


# 12 token alignment

class Plain:
    """Groups by the offsets where both end, links as all pairs; whole texts, straight from the libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_TOKENIZER)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.value = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        size_a = [bytes(self.value[c] for c in self.a.id_to_token(i)) for i in a]
        pieces = [self.b.id_to_piece(i) for i in b]
        size_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else
                  p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(size_a) == b"".join(size_b) == (" " + text).encode():
            return []
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (size_a, size_b)]
        both = sorted(ends[0] & ends[1])
        out = [([], []) for _ in both]
        for k, (ids, sizes) in enumerate(((a, size_a), (b, size_b))):
            at = 0
            for i, s in zip(ids, sizes):
                at += len(s)
                out[bisect.bisect_left(both, at)][k].append(i)
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain_alignment(plain, texts):
    cut = [plain.groups(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in cut]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, c in zip(cut, links):
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(shown(g).encode()).hexdigest() if g else ""))
    return out


HARD = ["", " ", "  ", "\n", " \n", "a ", "a  b", "a\n\n b", "x\r\ny", "a\r b", "\r\r \r", "a\tb \t c", "▁a b",
        "a▁", "<s> </s> <|endoftext|> <0x41>", "日本語 テキスト", "é é", "😀😀 👩‍👩‍👧", "don't we'll  I'M",
        "a\xa0b　 c\x85 d\x1c e", "1234567890 12", "....,,,;;", "ab" * 200, "'" * 77, "\0 a\0",
        "Donau" + "dampf" * 50, " leading", "trailing \n", "a \n b \n\n  c", "the  end"]


def test_alignment(spark, plain):
    texts = [t for _, t, _ in odd_docs()] + HARD + HARD[:5] + [None]
    docs = spark.createDataFrame([(i % 7 if i % 3 else None, t, "x", 1, 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, pair string, n int, row int").repartition(3)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((i % 7 if i % 3 else None, *x) for i, x in enumerate(plain_alignment(plain, texts)))
    for limit in (align.HEAD, 500, 0):  # counts that travel, and those that meet in a join
        out = align.aligned_documents(docs, BYTE_TOKENIZER, PIECE_MODEL, limit=limit) if limit else None
        if out is None:
            table = align.written(align.aligned(docs, BYTE_TOKENIZER, PIECE_MODEL))
            counts = align.written(align.pair_counts(table, 32_000))
            out = align.scored(table, counts, 3)
        assert Counter(tuple(r) for r in out.select("doc_id", *columns).collect()) == want
    assert align.aligned_documents(docs.limit(0), BYTE_TOKENIZER, PIECE_MODEL).count() == 0


@given(st.lists(st.text(alphabet=st.one_of(
    st.sampled_from(" \n\t\r'.,ab1éß▁<>|\xa0　\x85\x1c\x00日😀"), st.characters(codec="utf-8")),
    max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_alignment_of_any_text(plain, texts):
    one = align.aligner(BYTE_TOKENIZER, PIECE_MODEL)
    for text, got in zip(texts, one.align(texts)):
        g = plain.groups(text)
        assert got[4] == (hashlib.sha256(shown(g).encode()).hexdigest() if g else ""), repr(text)
        links = Counter(x * 32_000 + y for a, b in g for x in a for y in b)
        assert dict(zip(got[5].tolist(), got[6].tolist())) == links
        assert got[:4] == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g),
                           sum(links.values()))


def test_models_cut_texts():
    one = align.aligner(BYTE_TOKENIZER, PIECE_MODEL)
    assert one.cuts and one.chunks("a  b\nc\r d\t") == [" a", "  b", "\nc\r d\t"]


def test_wide_groups_are_exact(plain, monkeypatch):
    texts = ["日本語" * 20 + " x", "ab" * 300, "🏴" * 30, prose(random.Random(1), 50)]
    want = [align.aligner(BYTE_TOKENIZER, PIECE_MODEL).align([t])[0] for t in texts]
    monkeypatch.setattr(align, "WIDE", 0)
    for t, w in zip(texts, want):
        got = align.Aligner(BYTE_TOKENIZER, PIECE_MODEL).align([t])[0]
        assert got[:5] == w[:5] and (got[5] == w[5]).all() and (got[6] == w[6]).all()


def test_intervals():
    order, group = align.coalesced(np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 6, 2, 5, 6]),
                                   np.array([0, 0, 0, 1, 1, 1]))
    assert order.tolist() == [0, 3, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]


# 13 archives

def pages_rows():
    big = "<p>" + "q" * 200
    return [(5, "http://a/5", big), (3, "http://a/3", big), (None, None, big), (9, "x\r\ny: z", "short"),
            (8, "http://a/8", "short"), (7, None, None), (6, "", ""), (3, "http://a/3", big),
            (1, "http://a/1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (2, "é 日", "日" * 40),
            (4, "http://a/4", "日" * 40), (10, "u", "\x1f\x8b\x08" * 60), (None, None, "z" * 150),
            (11, "http://a/11", "long " * 400_000)]


def plain_pages(rows):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        first = min((k for k, _, h in rows if k is not None and (h or "").encode() == data), default=None)
        again = len(data) >= 100 and first is not None and key != first
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first if again else None))
    return Counter(out)


def test_archives(spark, tmp_path):
    rows = pages_rows()
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, "
                                  "digest string, first int, key int").repartition(3)
    folder = tmp_path / "archives"
    archives = warc.write_archives(pages, folder=str(folder), size=2_000)
    listed = {r["path"]: r["bytes"] for r in archives.collect()}
    assert {str(p): p.stat().st_size for p in folder.iterdir()} == listed and len(listed) > 3
    records, gaps = warc.read_archives(archives)
    assert gaps.count() == 0
    out = warc.resolved(records)
    assert Counter((int(r["key"]) if r["key"] else None, r["payload_bytes"], r["payload_digest"],
                    r["record_type"], int(r["refers_to_key"]) if r["refers_to_key"] else None)
                   for r in out.collect()) == plain_pages(rows)
    payloads = {r["key"]: r["payload"] for r in records.where("record_type = 'response'").collect()}
    assert bytes(payloads["11"]) == b"long " * 400_000 and bytes(payloads["2"]) == ("日" * 40).encode()
    urls = {r["key"]: r["url"] for r in records.collect()}
    assert urls["9"] == "x%0D%0Ay:%20z" and urls["7"] is None and urls["6"] == ""
    none = warc.write_archives(pages.limit(0), folder=str(tmp_path / "none"))
    found, lost = warc.read_archives(none)
    assert none.count() == found.count() == lost.count() == 0


def test_records_survive_what_is_around_them(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"{i} " * 500) for i in range(30)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")
                                   .coalesce(1), folder=str(tmp_path))
    records, _ = warc.read_archives(archives)
    places = {int(r["key"]): (r["start"], r["end"]) for r in records.where("key IS NOT NULL").collect()}
    path = archives.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[places[4][0] + 40] ^= 0xFF  # inside the member
    data[places[5][0]] = 0  # the signature of the next
    data[places[9][1] - 6] ^= 1  # the checksum
    del data[places[29][1] - 10:]  # the end of the file
    with open(path, "wb") as file:
        file.write(data)
    records, gaps = warc.read_archives(archives)
    assert {int(r["key"]) for r in records.where("key IS NOT NULL").collect()} == set(range(30)) - {4, 5, 9, 29}
    assert {(r["start"], r["end"]) for r in gaps.collect()} == {
        (places[4][0], places[5][1]), places[9], (places[29][0], places[29][1] - 10)}
    assert {r["start"]: r["reason"] for r in gaps.collect()}[places[9][0]] == "checksum"


def members(rows):
    return [warc.member(warc.page_record(i, None, p, None, "1970-01-01T00:00:00Z")) for i, p in rows]


def read_all(data):
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))


@given(st.binary(max_size=400), st.lists(st.binary(max_size=300), max_size=6), st.binary(max_size=50),
       st.integers(0, 2**30), st.booleans())
@settings(max_examples=150, deadline=None)
def test_bytes_are_in_a_record_or_a_gap(before, payloads, behind, flip, packed):
    parts = members(enumerate(payloads)) if packed else [
        warc.page_record(i, None, p, None, "1970-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    data = bytearray(b"".join(parts) + behind) if flip % 3 else bytearray(before + b"".join(parts))
    if data and flip % 2:
        data[flip % len(data)] ^= 1 + flip % 255
    at = 0
    for x in read_all(bytes(data)):
        assert x.start == at and x.end > at
        at = x.end
        if isinstance(x, warc.Record) and "x-key" in x.headers:
            assert x.payload == payloads[int(x.headers["x-key"])]  # never a damaged one
    assert at == len(data)


def test_long_members_and_plain_files():
    rng = np.random.default_rng(1)
    payloads = [rng.bytes(300_000), b"\0" * 3_000_000, rng.bytes(warc.PIECE), b""]
    data = b"".join(members(enumerate(payloads)))
    assert [x.payload for x in read_all(data)] == payloads
    plain = b"".join(warc.page_record(i, None, p, None, "1970-01-01T00:00:00Z")
                     for i, p in enumerate(payloads))
    assert [x.payload for x in read_all(plain)] == payloads
    broken = plain[:200_000] + b"?" + plain[200_001:]
    found = read_all(broken)
    assert isinstance(found[0], warc.Gap) and found[0].reason == "block digest"
    assert [x.payload for x in found[1:]] == payloads[1:]
    assert read_all(b"") == [] and [x.reason for x in read_all(b"nothing here")] == ["version"]
    more = warc.record("metadata", [("X", "y")], b"abc")[:-4] + b"!!!!"
    assert [x.reason for x in read_all(more)] == ["length"]
    sha1 = plain.replace(b"WARC-Block-Digest: sha256:", b"WARC-Block-Digest: sha999:")
    assert len([x for x in read_all(sha1) if isinstance(x, warc.Record)]) == 4  # a method not known


def test_a_bomb_stops_at_the_stated_length():
    liar = warc.record("response", [("X", "y")], b"abc") + b"\0" * 50_000_000
    found = read_all(warc.member(liar) + members([(1, b"good" * 50)])[0])
    assert isinstance(found[0], warc.Gap) and found[0].reason == "length"
    assert found[1].payload == b"good" * 50
