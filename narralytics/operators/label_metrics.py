"""Label metrics. Rows are counted once per (gold, predicted) cell; all scores come from the counts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralytics.constants import EMOTION_LABELS
from narralytics.functions.labels import vocabulary
from narralytics.functions.text import display_label, title_label
from narralytics.operators.align import ValidationError

MAX_MATRIX_LABELS = 1000
GOLD, PRED = "emotion_label", "predicted_emotion_label"


def _label(column: str) -> Column:
    """A null label counts as an empty one, in every metric alike."""
    return F.coalesce(F.col(column), F.lit(""))


def accuracy(df: DataFrame, by: Sequence[str] = (), gold: str = GOLD, pred: str = PRED) -> DataFrame:
    hit = (_label(gold) == _label(pred)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def correctness(df: DataFrame, gold: str = GOLD, pred: str = PRED) -> DataFrame:
    """A null label counts as the empty one, as in the accuracy."""
    return df.select("sample_id", gold, pred, (_label(gold) == _label(pred)).alias("emotion_correct"))


def cell_counts(df: DataFrame, by: Sequence[str] = (), gold: str = GOLD, pred: str = PRED) -> DataFrame:
    """Sparse confusion counts; partial aggregation leaves a handful of rows per task."""
    return df.groupBy(*by, _label(gold).alias("gold"), _label(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_grid(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zero-filled square over every label seen on either side (long form)."""
    seen = cells.select(*by, F.explode(F.array("gold", "pred")).alias("label"))
    grid = seen.groupBy(*by).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    stop = F.raise_error(F.lit(f"more than {MAX_MATRIX_LABELS} labels for a square matrix")).cast("array<string>")
    checked = F.when(F.size("labels") <= MAX_MATRIX_LABELS, F.col("labels")).otherwise(stop)
    grid = (grid.select(*by, "labels", F.explode(checked).alias("gold")).select(*by, "gold", F.explode("labels").alias("pred")))
    joined = grid.join(cells, [*by, "gold", "pred"], "left")
    return joined.select(*by, "gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(cells: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide form with one column per listed label, shown under its display name."""
    shown = cells.select(*by, display_label(F.col("gold")).alias("gold"), display_label(F.col("pred")).alias("pred"), "n")
    names = [x if x else "empty_prediction" for x in labels]
    return shown.groupBy(*by, "gold").pivot("pred", names).agg(F.sum("n")).na.fill(0)


def label_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every label seen; a zero denominator scores 0."""
    zero, n, hit = F.lit(0).cast("long"), F.col("n"), F.col("gold") == F.col("pred")
    roles = cells.select(*by, F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.when(hit, n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")),
    )).alias("r")).select(*by, "r.*")
    totals = roles.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    rate = lambda over: F.coalesce(F.try_divide(F.col("tp").cast("double"), over), F.lit(0.0))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))
    return totals.select(
        *by, "label", "support", "predicted", "tp",
        rate(F.col("predicted")).alias("precision"), rate(F.col("support")).alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"))


def macro_f1(cells: DataFrame, policy: str = "union", by: Sequence[str] = (),
             labels: Sequence[str] = tuple(EMOTION_LABELS)) -> DataFrame:
    """Macro-F1 under a named label policy.

    ``union``: mean over labels seen on either side, the empty string included.
    ``fixed``: mean over the vocabulary; an absent label scores 0 and an unknown prediction only
    costs recall.
    """
    scores = label_scores(cells, by)
    if policy == "union":
        return scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    if policy != "fixed":
        raise ValueError(f"unknown label policy {policy!r}")
    known = scores.where(F.col("label").isin(list(labels)))
    return known.groupBy(*by).agg((F.sum("f1") / F.lit(float(len(labels)))).alias("macro_f1"))


def complete_rows(df: DataFrame, gold: str = GOLD, pred: str = PRED, labels: Sequence[str] = tuple(EMOTION_LABELS),
                  check: bool = True) -> DataFrame:
    """Rows with both labels, title-cased; any unknown label is an error."""
    rows = df.dropna(subset=[gold, pred]).withColumn(gold, title_label(F.col(gold))).withColumn(pred, title_label(F.col(pred)))
    if check:
        unknown = (rows.select(F.explode(F.array(gold, pred)).alias("label"))
                   .where(~F.col("label").isin(list(labels))).distinct().take(10))
        if unknown:
            raise ValidationError(f"unknown labels {[r[0] for r in unknown]}")
    return rows


def label_summary(cells: DataFrame) -> DataFrame:
    """Long (metric, value) table: accuracy, macro-F1 and three scores per label."""
    scores = label_scores(cells).select(
        display_label(F.col("label")).alias("name"),
        F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (part, value)"))
    per_label = scores.select(F.concat_ws("_", "name", "part").alias("metric"), "value")
    overall = cells.agg(
        (F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))
    return (overall.select(F.lit("accuracy").alias("metric"), "value")
            .unionByName(macro_f1(cells).select(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")))
            .unionByName(per_label))


def label_distribution(df: DataFrame, column: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts in vocabulary order with zeros for labels that never occur."""
    counts = df.groupBy(*by, F.col(column).alias("label")).agg(F.count("*").alias("n"))
    if not by:
        base = vocabulary(df.sparkSession, list(labels))
    else:
        base = df.select(*by).distinct().withColumn("_v", F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(x).alias("label")) for i, x in enumerate(labels)])))
        base = base.select(*by, "_v.*")
    joined = base.join(counts, [*by, "label"], "left")
    return joined.select(*by, "position", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def relative_distribution(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Share of each non-null value, rounded half to even."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the grouped table: one row per value
    return counts.select("value", F.bround(F.col("n") / total, digits).alias("share"))
