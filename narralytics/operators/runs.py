"""Run-artifact tables: summaries, checkpoints, early stopping, telemetry and job status."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.constants import JOB_STATUSES
from narralytics.operators.align import ValidationError
from narralytics.operators.label_metrics import label_distribution

# fixed values: other names under which a summary metric is also stored
METRIC_ALIASES = {"accuracy": "emotion_accuracy", "macro_f1": "emotion_macro_f1",
                  "normalized_dtw_distance_mean": "normalized_dtw_mean"}


def build_summary(sources: Sequence[DataFrame | None], aliases: dict[str, str] = METRIC_ALIASES) -> DataFrame:
    """One (metric, value) row per metric; later sources win, aliases are added when free."""
    ranked = [s.select("metric", F.col("value").cast("double").alias("value"), F.lit(i).alias("_rank"))
              for i, s in enumerate(sources) if s is not None]
    merged = ranked[0]
    for s in ranked[1:]:
        merged = merged.unionByName(s)
    # a metric and its alias leave one scan as two rows; an alias ranks below every real metric
    alias = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), F.col("metric"))
    rows = merged.select(F.explode(F.array_compact(F.array(
        F.struct("metric", "value", "_rank"),
        F.when(alias.isNotNull(), F.struct(alias.alias("metric"), "value", (F.col("_rank") - F.lit(len(ranked))).alias("_rank")))))).alias("r"))
    return rows.select("r.*").groupBy("metric").agg(F.max_by("value", "_rank").alias("value"))


def check_summary(recomputed: DataFrame, stored: DataFrame, tolerance: float = 1e-9, by: Sequence[str] = ()) -> DataFrame:
    """Largest difference between recomputed and stored metrics, and whether all are within tolerance.

    A metric that only one side has, or that is no number, is unequal; nothing to compare at all is an error.
    """
    both = recomputed.select(*by, "metric", F.col("value").alias("_a")).join(
        stored.select(*by, "metric", F.col("value").alias("_b")), [*by, "metric"], "full_outer")
    gap = F.nanvl(F.abs(F.col("_a") - F.col("_b")), F.lit(None).cast("double"))
    found = both.groupBy(*by).agg(F.max(gap).alias("max_difference"), F.count("*").alias("metrics"),
                                  F.count_if(F.coalesce(gap <= tolerance, F.lit(False))).alias("_close"))
    nothing = F.raise_error(F.lit("no metric to compare")).cast("boolean")
    return found.withColumn("equal", F.when(F.col("metrics") > 0, F.col("_close") == F.col("metrics")).otherwise(nothing)).drop("_close")


def join_training(manifest: DataFrame, results: DataFrame, min_epoch: float, global_step: int, check: bool = True) -> DataFrame:
    """Manifest rows with their training result; an absent or unfinished result is an error."""
    joined = manifest.join(results, "model_path", "left")
    if check:
        finished = (F.col("epoch") >= min_epoch) & (F.col("global_step") == global_step)
        bad = joined.where(~F.coalesce(finished, F.lit(False))).select("model_path").take(5)
        if bad:
            raise ValidationError(f"unfinished training in {[r[0] for r in bad]}")
    return joined


def validation_history(states: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """(by, step, eval_loss) from checkpoint logs: the entry of the latest checkpoint wins per step."""
    entries = states.select(*by, "checkpoint", F.posexplode("log_history").alias("_pos", "e")).where(
        F.col("e.eval_loss").isNotNull() & F.col("e.step").isNotNull())
    return last_per_step(entries.select(*by, F.struct("checkpoint", "_pos").alias("checkpoint"), "e.step", "e.eval_loss"), by)


def last_per_step(entries: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return entries.groupBy(*by, "step").agg(F.max_by("eval_loss", "checkpoint").alias("eval_loss"))


def early_stop(history: DataFrame, by: Sequence[str] = ("run",), patience: int = 2, degradation: float = 0.10) -> DataFrame:
    """Stop decision per run: the latest loss is too far above the best, or patience ran out.

    The best step is the first minimum. Aggregates only, so one very long history is no hot task.
    """
    ends = history.groupBy(*by).agg(
        F.min(F.struct("eval_loss", "step")).alias("_best"), F.max(F.struct("step", "eval_loss")).alias("_last"))
    best = ends.select(*by, F.col("_best.step").alias("best_step"), F.col("_best.eval_loss").alias("best_loss"),
                       F.col("_last.step").alias("latest_step"), F.col("_last.eval_loss").alias("latest_loss"))
    later = history.join(best.select(*by, "best_step"), list(by)).groupBy(*by).agg(
        F.count_if(F.col("step") > F.col("best_step")).alias("validations_without_improvement"))
    relative = F.col("latest_loss") / F.col("best_loss") - 1.0
    reason = (F.when((F.col("latest_step") != F.col("best_step")) & (F.col("relative_degradation") >= degradation),
                     "immediate_relative_degradation_threshold")
              .when(F.col("validations_without_improvement") >= patience, "validation_patience_exhausted"))
    return best.join(later, list(by)).withColumn("relative_degradation", relative).withColumn("reason", reason)


def available_checkpoints(history: DataFrame, files: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """History rows whose checkpoint files still exist."""
    return history.join(files.select(*by, "step").distinct(), [*by, "step"], "left_semi")


def select_checkpoint(history: DataFrame, by: Sequence[str] = ("run",), named: DataFrame | None = None,
                      runs: DataFrame | None = None) -> DataFrame:
    """The step with the lowest loss per run, or the one that ``named`` (by, step) asks for.

    A run of ``runs`` without any candidate left is an error.
    """
    if named is not None:
        asked = named.select(*by, F.col("step").alias("_step"))
        history = history.join(asked, list(by), "left").where(F.col("_step").isNull() | (F.col("_step") == F.col("step"))).drop("_step")
    if runs is not None:
        lost = runs.select(*by).distinct().join(history.select(*by).distinct(), list(by), "left_anti").take(5)
        if lost:
            raise ValidationError(f"no checkpoint is left for {[tuple(r) for r in lost]}")
    return history.groupBy(*by).agg(F.min(F.struct("eval_loss", "step")).alias("_b")).select(
        *by, F.col("_b.step").alias("selected_step"), F.col("_b.eval_loss").alias("selected_loss"))


def with_phases(records: DataFrame) -> DataFrame:
    """A row per record and phase: training while runs are going, evaluation while evaluating; a record can be both."""
    training = F.when(F.coalesce(F.col("training_running"), F.lit(0)) > 0, "training")
    evaluation = F.when(F.col("evaluation_phase") == "evaluating", "evaluation")
    return records.withColumn("phase", F.explode(F.array_compact(F.array(training, evaluation))))


def telemetry_rollup(records: DataFrame, by: Sequence[Column | str] = ("phase",), busy: float = 90.0) -> DataFrame:
    """Device statistics per phase: records, observations, utilisation, busy share, power, temperature."""
    observed = records.select(*by, F.size("gpus").alias("_size"), F.posexplode("gpus").alias("_pos", "g"))
    return observed.groupBy(*by).agg(
        F.count_if(F.col("_pos") == 0).alias("samples"), F.count("*").alias("observations"),
        F.avg("g.utilization_percent").alias("mean_utilization"), F.count_if(F.col("g.utilization_percent") >= busy).alias("busy_observations"),
        F.avg((F.col("g.utilization_percent") >= busy).cast("double")).alias("busy_share"),
        F.avg("g.power_w").alias("mean_power_w"), F.max("g.temperature_c").alias("maximum_temperature_c"))


def job_status(manifest: DataFrame, statuses: Sequence[str] = tuple(JOB_STATUSES)) -> DataFrame:
    return label_distribution(manifest, "status", list(statuses)).withColumnRenamed("label", "status")


def weighted_loss(losses: DataFrame, weight: float, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean loss per task and their combination (w * label + narrative) / (w + 1)."""
    of = lambda task: F.avg(F.when(F.col("task") == task, F.col("loss")))
    return losses.groupBy(*by).agg(of("label").alias("label_loss"), of("narrative").alias("narrative_loss")).withColumn(
        "weighted_loss", (F.lit(weight) * F.col("label_loss") + F.col("narrative_loss")) / F.lit(weight + 1.0))
