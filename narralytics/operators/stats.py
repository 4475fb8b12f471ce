"""Seed-level statistics over long metric tables (dataset, condition, seed, metric, value)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from narralytics.constants import LOWER_IS_BETTER
from narralytics.functions import kernels
from narralytics.operators.align import ValidationError

MAX_SIGN_FLIP_SEEDS = 40   # two halves of 2^20 sums
ZERO = 1e-12


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else kernels.t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical_value(df: pd.Series) -> pd.Series:
    return df.map(lambda n: None if pd.isna(n) or n < 1 else kernels.t_critical(n)).astype("float64")


@F.pandas_udf(DoubleType())
def _mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x + y == 0 else min(1.0, 2.0 * kernels.binomial_half_tail(min(x, y), x + y)) for x, y in zip(b, c)])


def direction(metric: Column, lower_is_better: Sequence[str] = tuple(LOWER_IS_BETTER)) -> Column:
    """-1 for metrics where lower is better, else 1."""
    return F.when(metric.isin(list(lower_is_better)), F.lit(-1.0)).otherwise(F.lit(1.0))


def unpivot_metrics(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide run summaries to (keys, metric, value)."""
    return runs.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select(*keys, "r.*")


def seed_metrics(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("dataset", "condition", "seed"),
                 check: bool = True) -> DataFrame:
    """Long metric table of complete runs; a run with missing predictions is an error."""
    if check:
        bad = runs.where(F.coalesce(F.col("num_missing_prediction_rows"), F.lit(0)) != 0).select(*keys).take(5)
        if bad:
            raise ValidationError(f"missing predictions in {[tuple(r) for r in bad]}")
    return unpivot_metrics(runs, keys, metrics)


def condition_summary(metrics: DataFrame, keys: Sequence[str] = ("dataset", "condition", "metric")) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count("value").alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def with_t_interval(summary: DataFrame, mean: str = "mean", sd: str = "sd", n: str = "n_seeds", prefix: str = "ci_95") -> DataFrame:
    margin = t_critical_value((F.col(n) - 1).cast("double")) * F.col(sd) / F.sqrt(F.col(n))
    return (summary.withColumn("_margin", margin).withColumn(f"{prefix}_low", F.col(mean) - F.col("_margin"))
            .withColumn(f"{prefix}_high", F.col(mean) + F.col("_margin")).drop("_margin"))


def seed_advantages(metrics: DataFrame, treatment: str, control: str, by: Sequence[str] = ("dataset", "metric")) -> DataFrame:
    """Direction-corrected difference of two conditions per seed; every seed needs both values."""
    wide = metrics.where(F.col("condition").isin(treatment, control)).groupBy(*by, "seed").agg(
        F.max(F.when(F.col("condition") == treatment, F.col("value"))).alias("treatment"),
        F.max(F.when(F.col("condition") == control, F.col("value"))).alias("control"))
    advantage = direction(F.col("metric")) * (F.col("treatment") - F.col("control"))
    lone = F.raise_error(F.concat(F.lit("seed without both conditions: "), F.col("seed").cast("string"))).cast("double")
    both = F.col("treatment").isNotNull() & F.col("control").isNotNull()
    return wide.withColumn("advantage", F.when(both, advantage).otherwise(lone))


@F.pandas_udf(DoubleType())
def _sign_flip(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or not len(v) else kernels.sign_flip_share(v) for v in values], dtype="float64")


def sign_flip_p(values: Column) -> Column:
    """Share of all 2^k sign vectors whose mean is at least as far from 0 as the observed one.

    The sign vectors are split in the middle: the 2^(k/2) signed sums of each half are made, one half is sorted, and for every sum of the other the
    partners beyond the limits are counted by their places. More than ``MAX_SIGN_FLIP_SEEDS`` values are an error.
    """
    too_many = F.raise_error(F.lit(f"the exact test takes at most {MAX_SIGN_FLIP_SEEDS} seeds")).cast("array<double>")
    return _sign_flip(F.when(F.size(values) <= MAX_SIGN_FLIP_SEEDS, values).otherwise(too_many))


def _spread(column: str) -> Column:
    """Sample standard deviation where rounding noise of equal values counts as none."""
    sd = F.stddev_samp(column)
    return F.when(sd < ZERO, 0.0).otherwise(sd)


def paired_tests(advantages: DataFrame, by: Sequence[str] = ("dataset", "metric")) -> DataFrame:
    """Paired t test with interval, Cohen's dz and the exact sign-flip test, one row per group."""
    grouped = advantages.groupBy(*by).agg(
        F.count("advantage").alias("n_seeds"), F.avg("treatment").alias("treatment_mean"), F.avg("control").alias("control_mean"),
        F.avg("advantage").alias("mean_advantage"), _spread("advantage").alias("_sd"),
        F.sort_array(F.collect_list("advantage")).alias("_values"))  # one value per seed
    df = (F.col("n_seeds") - 1).cast("double")
    t = F.try_divide(F.col("mean_advantage"), F.col("_sd") / F.sqrt(F.col("n_seeds")))
    tested = with_t_interval(grouped, "mean_advantage", "_sd", "n_seeds", "advantage_ci_95")
    p = F.when(F.col("_sd") > 0, t_p_value(t, df)).when(F.abs("mean_advantage") > ZERO, 0.0)  # no spread: certain, or undefined at 0
    return (tested.withColumn("cohen_dz", F.try_divide(F.col("mean_advantage"), F.col("_sd")))
            .withColumn("paired_t_p", p).withColumn("exact_sign_flip_p", sign_flip_p(F.col("_values")))
            .drop("_sd", "_values"))


def holm(tests: DataFrame, by: Sequence[str], p: str, tie: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjustment within each family."""
    family = Window.partitionBy(*by)
    ordered = family.orderBy(p, tie)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(ordered) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn(
        out, F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def mcnemar(pairs: DataFrame, by: Sequence[str] = (), gold: str = "gold", a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """Exact test on discordant correctness of two systems."""
    hit_a, hit_b = F.col(gold) == F.col(a), F.col(gold) == F.col(b)
    counts = pairs.groupBy(*by).agg(F.count_if(hit_a & ~hit_b).alias("only_a"), F.count_if(~hit_a & hit_b).alias("only_b"))
    return counts.withColumn("p_value", _mcnemar("only_a", "only_b"))


def compare_two(metrics: DataFrame, baseline: str, candidate: str, by: Sequence[str] = ("dataset", "metric"),
                system: str = "condition") -> DataFrame:
    """Two-system table with the direction-corrected improvement of the candidate."""
    wide = metrics.groupBy(*by).pivot(system, [baseline, candidate]).agg(F.first("value"))
    base, cand = F.col(baseline), F.col(candidate)
    return wide.select(*by, base.alias("baseline_value"), cand.alias("candidate_value"),
                       (direction(F.col("metric")) > 0).alias("higher_is_better"),
                       (direction(F.col("metric")) * (cand - base)).alias("improvement"))


def best_setting(metrics: DataFrame, order: Mapping[str, int], by: Sequence[str] = ("dataset", "metric"),
                 setting: str = "condition") -> DataFrame:
    """Best setting per metric, direction-aware; ties go to the earlier setting."""
    position = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(setting))
    signed = -direction(F.col("metric")) * F.col("value")
    return metrics.where(F.col(setting).isin(list(order))).groupBy(*by).agg(
        F.min_by(F.struct(setting, "value"), F.struct(signed.alias("s"), position.alias("p"))).alias("_b")).select(
        *by, F.col(f"_b.{setting}").alias("best_setting"), F.col("_b.value").alias("best_value"))


def compare_settings(metrics: DataFrame, baseline: str, settings: Sequence[str], training: DataFrame | None = None,
                     by: Sequence[str] = ("dataset", "metric"), setting: str = "condition") -> DataFrame:
    """All settings side by side with the baseline and the best one; optional training columns of the best."""
    wide = metrics.groupBy(*by).pivot(setting, [baseline, *settings]).agg(F.first("value"))
    best = best_setting(metrics, {s: i for i, s in enumerate(settings)}, by, setting)
    out = wide.withColumnRenamed(baseline, "baseline_value").join(best, list(by))
    return out if training is None else out.join(
        training.withColumnRenamed(setting, "best_setting"), "best_setting", "left")


def run_table(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ("dataset", "condition", "seed")) -> DataFrame:
    """One row per run, one column per metric."""
    return metrics.groupBy(*by).pivot("metric", list(names)).agg(F.first("value"))


def verdict(results: DataFrame, favoured: str = "favored", treatment: str = "treatment", control: str = "control",
            min_wins: int = 1) -> DataFrame:
    """Overall reading of a family of comparisons from its wins and losses; fewer than ``min_wins`` wins are none."""
    counts = results.agg(F.count("*").alias("comparisons"), F.count_if(F.col(favoured) == treatment).alias("wins"),
                         F.count_if(F.col(favoured) == control).alias("losses"))
    return counts.withColumn("verdict", F.when(F.col("wins") == F.col("comparisons"), "consistent_improvement")
                             .when((F.col("wins") >= min_wins) & (F.col("losses") == 0), "partial_improvement")
                             .when(F.col("losses") > 0, "not_superior").otherwise("no_clear_difference"))


def tally(comparison: DataFrame, improvement: str = "improvement") -> DataFrame:
    return comparison.agg(F.count_if(F.col(improvement) > 0).alias("improved"),
                          F.count_if(F.abs(F.col(improvement)) < 1e-12).alias("tied"), F.count("*").alias("comparisons"))


def formatted_summary(summary: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("dataset", "condition")) -> DataFrame:
    cell = F.format_string("%.5f +/- %.5f", F.col("mean"), F.col("sd"))
    return summary.withColumn("_cell", cell).groupBy(*by).pivot("metric", list(metrics)).agg(F.first("_cell"))
