"""Registered queries of the operators, and the pipeline stage by stage."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from crowdcover.llm import jaccard_join, line_dedup, quality_rules
from oracle import compare, connect
from test_operators import check_packing, plain_components, plain_line_dedup, plain_measures, prose

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op")]


def test_all_are_registered():
    found = {n.split("_")[0] for n in NAMES}
    assert found == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    verdict, n, info = compare(spark, connect(FOLDER), FOLDER, entry.queries()[name],
                               entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows") and n > 0, info


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            check_packing(docs.collect(), before, 4096)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= ids and after
        if name == "quality_rules":
            for d, text in before:
                m, _ = plain_measures(text)
                assert (d in after) == (m[0] >= 50 and 100 * m[4] <= 50 * m[0])  # no host is rejected
        if name == "line_dedup":
            want = plain_line_dedup(before)
            assert {d: r["text"] for d, r in after.items()} == {
                d: t for d, (t, n) in want.items() if not n or t.split()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "jaccard_join":
            groups = plain_components(before)
            assert set(after) == {c for _, _, c in groups}
        ids = set(after)


def test_pipeline_on_odd_documents(spark, tmp_path):
    from test_operators import odd_docs
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in odd_docs()]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, frame in (("odd", rows), ("none", rows[:0])):
        folder = str(tmp_path / name)
        spark.createDataFrame(frame, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
            f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == (name == "odd")
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                               "offset"]


def test_near_copies_decide_per_row(spark):
    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (None, None), (None, ""), (4, c), (4, d), (5, c), (3, d),
            (6, e), (6, e), (7, b + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_copies(spark, docs, FOLDER)
    assert out.columns == ["doc_id", "text"]
    assert Counter(map(tuple, out.collect())) == Counter(
        [(None, a), (None, b), (None, None), (None, ""), (4, c), (3, d), (6, e)])


def test_operators_are_the_ones_the_stages_call():
    assert jaccard_join.WORDS == 5 and line_dedup.WINDOW == 3 and quality_rules.MIN_WORDS == 50


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Own columns with the names of the operators' results come back as they were."""
    names = ["n_words", "kept", "score", "passages", "n_removed", "failed", "row", "segments"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == docs.columns and out.count()
        for n in names:
            assert out.where(f"{n} <> concat('{n}', doc_id)").isEmpty()
        docs = out
