"""Multi-seed comparison: one DataFrame of runs, one job per test."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.operators import resample as R
from narralytics.operators import stats as S


@dataclass
class Comparison:
    summary: DataFrame
    paired: DataFrame
    hierarchical: DataFrame
    verdict: DataFrame


def compare_conditions(run_summaries: DataFrame, per_sample: DataFrame, treatment: str, controls: Sequence[str],
                       run_metrics: Sequence[str], sample_metrics: Sequence[str], primary: Sequence[str],
                       samples: int = R.DEFAULT_SAMPLES, seed: int = 20260819, verdict_control: str | None = None,
                       min_wins: int = 1, portable: bool = False) -> Comparison:
    """``run_summaries``: one row per (dataset, condition, seed); ``per_sample``: one row per
    (dataset, condition, seed, sample_id) with a column per metric. The verdict reads the contrasts with
    ``verdict_control`` only, or with all controls."""
    metrics = S.seed_metrics(run_summaries, run_metrics)
    summary = S.with_t_interval(S.condition_summary(metrics))
    pairs = [S.seed_advantages(metrics, treatment, c).withColumn("control_name", F.lit(c)) for c in controls]
    tests = S.paired_tests(reduce(DataFrame.unionByName, pairs), ["dataset", "metric", "control_name"])
    paired = S.holm(tests, ["dataset", "metric"], "paired_t_p", "control_name", "paired_t_p_holm")
    wide = per_sample.groupBy("dataset", "seed", "sample_id").pivot("condition", [treatment, *controls]).agg(
        *[F.first(m).alias(m) for m in sample_metrics])
    cells = wide.select("dataset", "seed", "sample_id", *[
        F.col(f"{c}_{m}").alias(f"{m}__{c}") for c in (treatment, *controls) for m in sample_metrics])
    contrasts = {c: {treatment: 1, c: -1} for c in controls}
    tested = R.hierarchical_contrasts(cells, sample_metrics, contrasts, samples=samples, seed=seed, portable=portable)
    favoured = F.when(F.col("ci_95_low") > 0, F.lit("treatment")).when(F.col("ci_95_high") < 0, F.lit("control")).otherwise("no_clear_difference")
    hierarchical = tested.withColumn("favored", favoured)
    judged = hierarchical.where(F.col("metric").isin(list(primary)))
    if verdict_control is not None:
        judged = judged.where(F.col("contrast") == verdict_control)
    return Comparison(summary, paired, hierarchical, S.verdict(judged, min_wins=min_wins))
