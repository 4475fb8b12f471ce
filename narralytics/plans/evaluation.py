"""One evaluation run: align, score, merge, summarise."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.operators import align as A
from narralytics.operators import label_metrics as L
from narralytics.operators import overlap_metrics as O
from narralytics.operators import runs as R
from narralytics.operators import semantic as M
from narralytics.session import SMALL_GROUPS, small_splits, spread, stored


@dataclass
class Evaluation:
    """Outputs of a run; only the alignment and the numbers per sample that texts need are computed before a sink asks."""

    alignment: A.Alignment
    per_sample: DataFrame
    confusion: DataFrame
    summary: DataFrame


def row_counts(gold: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    """Gold, prediction, aligned and missing row counts from one full outer join of the ids."""
    left = gold.select(key, F.lit(1).alias("g"))
    right = pred.select(key, F.lit(1).alias("p"))
    both = left.join(right, key, "full_outer")
    counts = both.agg(
        F.count("g").alias("num_gold_rows"), F.count("p").alias("num_prediction_rows"),
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("num_aligned_rows"),
        F.count_if(F.col("p").isNull()).alias("num_missing_prediction_rows"))
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counts.columns])).alias("r")).select("r.*")


def failure_count(pred: DataFrame) -> DataFrame:
    """Predictions whose answer could not be parsed, as a summary row."""
    failed = ~F.coalesce(F.col("parse_success").cast("boolean"), F.lit(False))
    return pred.agg(F.count_if(failed).cast("double").alias("value")).select(F.lit("num_generation_failures").alias("metric"), "value")


def evaluate(gold: DataFrame, pred: DataFrame, labels: bool = True, overlap: bool = True, semantic: bool = True,
             stemmer: bool = True, extra_summaries: Sequence[DataFrame] = (), check: bool = True) -> Evaluation:
    """Metrics of predictions against gold rows. The aligned table feeds every branch; it is written once to the
    shared scratch folder, so no branch aligns again and no executor has to keep it. The texts are cut into words once for all
    metrics of texts, whose numbers per sample are written once as well."""
    parts = A.align(gold, pred, check=check)
    aligned = stored(spread(parts.aligned, "sample_id"), "aligned", **SMALL_GROUPS)
    tables, summaries = [], [row_counts(gold, pred)]
    if "parse_success" in pred.columns:
        summaries.append(failure_count(pred))
    cells = L.cell_counts(aligned)
    if overlap or semantic:
        with small_splits(gold.sparkSession):
            scores = stored(M.text_scores(aligned, overlap, semantic, stemmer), "text-scores")
    if overlap:
        per_sample, summary = O.overlap_metrics(scores, stemmer=stemmer, counted=True)
        tables.append(per_sample)
        summaries.append(summary)
    if semantic:
        scored = M.sentence_dtw(scores, counted=True).join(M.greedy_match(scores, counted=True), "sample_id")
        tables.append(scored)
        summaries.append(M.semantic_summary(scored))
    if labels:
        tables.append(L.correctness(aligned).select("sample_id", "emotion_correct"))
        summaries.append(L.label_summary(cells))
    return Evaluation(A.Alignment(aligned, parts.missing, parts.extra), A.attach_metrics(aligned, tables),
                      L.confusion_grid(cells), R.build_summary([*summaries, *extra_summaries]))
