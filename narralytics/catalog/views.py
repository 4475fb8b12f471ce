"""Stand-in views over the driver tables, as DataFrames and as the same view in oracle SQL.

Every view reads its tables whole. Gold rows are all documents and all benchmark items;
predictions exist for all documents and all conversation turns, so benchmark items are the missing
and conversation turns the extra predictions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.constants import EMOTION_LABELS
from narralytics.functions.text import collapse
from narralytics.session import spread

BENCHMARK_OFFSET = 1_000_000_000_000
CONVERSATION_OFFSET = 2_000_000_000_000
LABEL_LIST_SQL = "[" + ",".join(f"'{x}'" for x in EMOTION_LABELS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of files."""
    any_kind = f"{sf_dir}/{name}.[p]arquet"     # a stream takes a file only by a pattern
    return spark.readStream.schema(table(spark, sf_dir, name).schema).options(**options).parquet(any_kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table of very few files is spread over the cores before heavy text work."""
    docs = table(spark, sf_dir, "documents")
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = spread(docs, "doc_id")
    return docs


def pick_label(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in EMOTION_LABELS]), (F.pmod(n, F.lit(7)) + 1).cast("int"))


def drop_words(text: Column, step: int, phase: int) -> Column:
    """Every ``step``-th word left out: a systematic paraphrase of the whole text."""
    return F.array_join(F.filter(F.split(text, " "), lambda w, i: i % step != phase), " ")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.col("doc_id").alias("sample_id"), "text")
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), (F.col("item_id") + BENCHMARK_OFFSET).alias("sample_id"), "text")
    return docs.unionByName(items).select(
        "sample_id", collapse(F.col("text")).alias("source_text"),
        pick_label(F.col("doc_id")).alias("emotion_label"), collapse(F.col("text")).alias("reference_narrative"))


def predicted_label(doc_id: Column) -> Column:
    return (F.when(F.col("toxic") == 1, F.lit("")).when(F.col("quality") == 0, pick_label(doc_id * 3))
            .otherwise(pick_label(doc_id)))


def pred(spark: SparkSession, sf: str, step: int = 7, phase: int = 3) -> DataFrame:
    """Predictions for documents and turns. Texts meet their labels by sample id, as they later meet gold rows: they move and are sorted once."""
    from_docs = documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"), drop_words(collapse(F.col("text")), step, phase).alias("predicted_narrative"),
        F.lit("").alias("_turn_label"), F.lit(True).alias("_document"))
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + CONVERSATION_OFFSET).alias("sample_id"),
        collapse(F.col("text")).alias("predicted_narrative"),
        F.when(F.col("role") == "user", F.lit("Neutral")).otherwise(F.lit("Joy")).alias("_turn_label"), F.lit(False).alias("_document"))
    both = from_docs.unionByName(turns).alias("t").join(
        table(spark, sf, "labels").alias("l"), (F.col("t.sample_id") == F.col("l.doc_id")) & F.col("t._document"), "left")
    label = F.when(F.col("t._document"), predicted_label(F.col("t.sample_id"))).otherwise(F.col("t._turn_label"))
    return both.select("t.sample_id", "t.predicted_narrative", label.alias("predicted_emotion_label"))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return gold(spark, sf).join(pred(spark, sf), "sample_id")


NORM = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


def norm_sql(column: str) -> str:
    return NORM.format(column)


def label_sql(number: str) -> str:
    return f"list_extract({LABEL_LIST_SQL}, CAST(({number}) % 7 + 1 AS INTEGER))"


def drop_words_sql(text: str, step: int, phase: int) -> str:
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda w, i: (i - 1) % {step} <> {phase}), ' ')"


PRED_LABEL_SQL = (f"CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 0 THEN {label_sql('d.doc_id * 3')} "
                  f"ELSE {label_sql('d.doc_id')} END")

VIEW_SQL = {
    "gold": f"""gold AS (
        SELECT doc_id AS sample_id, {norm_sql('text')} AS source_text, {label_sql('doc_id')} AS emotion_label,
               {norm_sql('text')} AS reference_narrative FROM documents
        UNION ALL
        SELECT item_id + {BENCHMARK_OFFSET}, {norm_sql('text')}, {label_sql('item_id')}, {norm_sql('text')} FROM benchmark)""",
    "pred": f"""pred AS (
        SELECT d.doc_id AS sample_id, {drop_words_sql(norm_sql('d.text'), 7, 3)} AS predicted_narrative,
               {PRED_LABEL_SQL} AS predicted_emotion_label
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        UNION ALL
        SELECT conv_id * 1000 + turn + {CONVERSATION_OFFSET}, {norm_sql('text')},
               CASE WHEN role = 'user' THEN 'Neutral' ELSE 'Joy' END FROM conversations)""",
    "aligned": """aligned AS (
        SELECT g.*, p.predicted_narrative, p.predicted_emotion_label FROM gold g JOIN pred p ON p.sample_id = g.sample_id)""",
    "cells": """cells AS (
        SELECT emotion_label AS gold, predicted_emotion_label AS pred, count(*) AS n FROM aligned GROUP BY 1, 2)""",
    "label_scores": """label_scores AS (
        SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp,
               coalesce(sum(tp) / nullif(sum(predicted)::DOUBLE, 0), 0) AS "precision",
               coalesce(sum(tp) / nullif(sum(support)::DOUBLE, 0), 0) AS recall,
               coalesce(2.0 * sum(tp) / nullif((sum(support) + sum(predicted))::DOUBLE, 0), 0) AS f1
        FROM (SELECT gold AS label, n AS support, 0 AS predicted, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM cells
              UNION ALL SELECT pred, 0, n, 0 FROM cells) GROUP BY label)""",
}
NEEDS = {"aligned": ["gold", "pred"], "cells": ["aligned"], "label_scores": ["cells"]}


def with_views(views: list[str], body: str) -> str:
    """Oracle text: the named views (and what they need) as CTEs, then the body."""
    order: list[str] = []

    def add(view: str) -> None:
        for needed in NEEDS.get(view, []):
            add(needed)
        if view not in order:
            order.append(view)

    for v in views:
        add(v)
    return "WITH " + ",\n".join(VIEW_SQL[v] for v in order) + "\n" + body
