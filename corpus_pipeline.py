"""A corpus pipeline of five stages; each takes what its predecessor kept.

Documents need doc_id and text; other columns pass through all stages but the last, whatever their names. Texts may be null, empty
or very long, ids null or repeated, and tables empty: the operators say what becomes of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import common, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup


def aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's result in the columns of docs; meanwhile those that it doesn't work on have other names, so that none is taken for a result of the stage."""
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = stage(docs.withColumnsRenamed(names))
    return done.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier predicts as 0."""
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return aside(docs, lambda d: quality_classifier.classify(d, model).where("predicted = 1"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the counting rules or repeat themselves too much."""
    return aside(docs, lambda d: quality_rules.quality_rules(d, keep_text=True).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays (with every row that has this id; rows without an id stay)."""
    lost = ngram_join.ngram_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what a document with a smaller id has too; n_chars, where there is one, follows the text."""
    kept = aside(docs, lambda d: suffix_dedup.remove_repeats(d, keep_text=True))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' tokens in sequences of at most 2048."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_join", near_copies), ("suffix_dedup", repeats), ("packing", pack)]
#: Stages whose result is stored in the checkpoint folder, once, as the next one reads its texts in several exchanges; the first stage's rows go straight through the second.
STORED = {"quality_rules", "ngram_join", "suffix_dedup"}
#: A trained model and a vocabulary decide: no SQL expresses the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = common.checkpoint(docs) if name in STORED else docs
    return docs
