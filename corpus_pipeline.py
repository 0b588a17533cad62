"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns documents with
the columns it was given; the last returns the pieces of the sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdcover.llm import jaccard_join, line_dedup, packing, quality_rules, toxicity
from crowdcover.llm.common import small, told_apart, unused, written
from crowdcover.llm.queries import TRAIN, WORD_TOKENIZER
from crowdcover.session import checkpoint_dir


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with a name for every column but ``needed`` that no operator gives its own, and what gives
    the columns their names back, and drops all others."""
    names = {c: c if c in needed else f"own_{i}_" for i, c in enumerate(docs.columns)}
    return (docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]),
            lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go: also null and empty texts, which have
    too few words. A null host has no verdict; repeated rows count and go one by one; nothing is tied."""
    mine, back = apart(docs, "text", "source")
    return back(quality_rules.judge(mine).where("kept"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts are scored as texts without words; null
    ids have no label; repeated rows are scored alike; a score at the threshold is toxic."""
    mine, back = apart(docs, "doc_id", "text")
    model = toxicity.fit(mine, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(TRAIN))
    return back(toxicity.score(mine, model).where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which no word is left goes as a whole. Null texts and texts
    of fewer than three lines stay; of repeated rows one keeps its passages; null ids come first."""
    mine, back = apart(docs, "doc_id", "text")
    out = back(line_dedup.dedup(mine).where(r"n_removed = 0 OR text RLIKE '[^ \t-\r]'"))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked, the one with the smallest id stays; a null id is smaller than any
    other. Rows are told apart by a number of their own where ids are null or have several rows."""
    row, component, first = unused(docs, "row", "component", "first")
    numbered = (docs.withColumn(row, F.col("doc_id").cast("long")) if told_apart(docs, "doc_id")
                else written(docs.withColumn(row, F.monotonically_increasing_id())))
    found = jaccard_join.classes_of(numbered, doc_id=row).select(
        F.col("doc_id").alias(row), F.col("component_id").alias(component))
    rows = written(found.join(numbered.select(row, F.col("doc_id").cast("long").alias("id")), row))
    groups = written(rows.groupBy(component).agg(
        F.min(F.struct("id", row))[row].alias(first), F.count("*").alias("n"))
        .where("n > 1").drop("n"))
    gone = written(rows.join(small(groups), component).where(F.col(row) != F.col(first)).select(row))
    return numbered.join(small(gone), row, "left_anti").select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. Null and empty texts are a single end token; every row is a document of
    its own, also where ids are null or repeat; equal lengths pack in any order."""
    return packing.pack(docs, WORD_TOKENIZER).drop("class")


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("line_dedup", lines),
          ("jaccard_join", near_copies), ("packing", sequences)]

#: A model, components and a tokenizer are in it: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
