"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narralytics.llm import bpe, mixing, pii, quality, simhash
from narralytics.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by kind names; n_chars follows the new text."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mixing.sample(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.digests(docs.select(*COLUMNS))


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None  # no stage can be said in SQL; tests/llm/test_pipeline.py holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
