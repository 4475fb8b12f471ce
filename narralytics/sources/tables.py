"""CSV, JSON Lines, Parquet and nested-JSON sources, and the matching sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.functions.text import collapse, usable_comment
from narralytics.operators.align import GOLD_COLUMNS, PREDICTION_COLUMNS, ValidationError, require_columns, require_unique
from narralytics.operators.ranking import first_by_ordinal, rank_by_value
from narralytics.sources.split_csv import csv_records

ALPACA_SCHEMA = "system string, instruction string, input string, output string"
GOLD_SCHEMA = "source_text string, emotion_label string, reference_narrative string"
PREDICTION_SCHEMA = "sample_id string, predicted_narrative string, predicted_emotion_label string"
TOPIC_SUMMARY_SCHEMA = "topic_id int, count long, name string, top_terms array<string>, representative_docs array<string>"
TRAINER_STATE_SCHEMA = "best_metric double, global_step long, epoch double, log_history array<struct<step: long, eval_loss: double, epoch: double>>"
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with header, quoted newlines and doubled quotes; a leading byte-order mark is dropped.

    Columns are matched by header name, so files may hold more columns in any order; all files share the header of the
    first. Empty fields are null; the text ``NA`` stays text. Files are split like any text, also inside quoted fields.
    """
    header = spark.read.options(**CSV_OPTIONS).option("inferSchema", "false").csv(path)
    require_columns(header, required or [f.name for f in spark.createDataFrame([], schema).schema], path)
    wanted = spark.createDataFrame([], schema).schema
    kinds = ", ".join("`{}` string".format(c.replace("`", "``")) for c in header.columns)
    fields = csv_records(spark, path).select(F.from_csv("text", kinds, {k: v for k, v in CSV_OPTIONS.items() if k != "header"}).alias("r")).select("r.*")
    return fields.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def read_gold(spark: SparkSession, path: str, ordinal: str) -> DataFrame:
    """Gold rows with ``sample_id`` 0..n-1 in the order of a unique numeric column, texts normalised."""
    rows = read_csv(spark, path, f"{ordinal} long, {GOLD_SCHEMA}", GOLD_COLUMNS)
    ranked = rank_by_value(rows, ordinal, out="_rank").withColumn("sample_id", F.col("_rank") - 1)
    return ranked.select("sample_id", *[collapse(F.col(c)).alias(c) for c in GOLD_COLUMNS])


def read_predictions(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Predictions with a numeric unique id; text that is no number is an error in ANSI mode."""
    rows = read_csv(spark, path, PREDICTION_SCHEMA, PREDICTION_COLUMNS)
    typed = rows.select(F.col("sample_id").cast("double").cast("long").alias("sample_id"),
                        *[collapse(F.col(c)).alias(c) for c in PREDICTION_COLUMNS[1:]])
    return require_unique(typed, ["sample_id"], path) if check else typed


def read_comments(spark: SparkSession, path: str, ordinal: str, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Usable comments of a Parquet table, optionally the first n by ordinal and clipped to ``limit`` characters."""
    comments = spark.read.parquet(path).select(ordinal, "text").withColumn("text", usable_comment(F.col("text"), limit)).where("text is not null")
    return comments if rows is None else first_by_ordinal(comments, ordinal, rows)


def read_jsonl(spark: SparkSession, path: str, schema: str, check: bool = True) -> DataFrame:
    """JSON Lines where every row must have every key; an empty file is an error."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [c for c in rows.columns if c != "_corrupt"]
    if check:
        bad = F.lit(False)
        for name in names:
            bad = bad | F.col(name).isNull()
        counts = rows.select(bad.alias("bad")).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
        if not counts["n"]:
            raise ValidationError(f"no rows in {path}")
        if counts["bad"]:
            raise ValidationError(f"{counts['bad']} rows of {path} lack a field")
    return rows.select(*names)


def read_nested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one object or array of objects per file."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV that ``read_csv`` reads back unchanged: all fields quoted, quotes doubled, white space at the ends kept."""
    df.write.mode("errorifexists").options(header="true", quoteAll="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false",
                                           ignoreTrailingWhiteSpace="false").csv(path)
    return path
