"""Gold/prediction and run/run alignment, key checks and set operations."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.functions.text import key_digest, match_key

GOLD_COLUMNS = ["source_text", "emotion_label", "reference_narrative"]
PREDICTION_COLUMNS = ["sample_id", "predicted_narrative", "predicted_emotion_label"]


class ValidationError(ValueError):
    """Input breaks the contract of an operator."""


@dataclass
class Alignment:
    aligned: DataFrame
    missing: DataFrame
    extra: DataFrame


def require_columns(df: DataFrame, required: Sequence[str], name: str = "input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValidationError(f"{name} lacks columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "input") -> DataFrame:
    repeated = duplicate_keys(df, keys).select(*keys).take(10)
    if repeated:
        raise ValidationError(f"{name} repeats {list(keys)}: {[tuple(r) for r in repeated]}")
    return df


def missing_predictions(gold: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    return gold.join(pred.select(key), key, "left_anti").withColumn("status", F.lit("missing_prediction"))


def extra_predictions(gold: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    return pred.join(gold.select(key), key, "left_anti").withColumn("status", F.lit("extra_prediction"))


def align(gold: DataFrame, pred: DataFrame, key: str = "sample_id", check: bool = True) -> Alignment:
    """One-to-one inner alignment plus the rows only one side has."""
    if check:
        require_unique(gold, [key], "gold")
        require_unique(pred, [key], "predictions")
    return Alignment(gold.join(pred, key), missing_predictions(gold, pred, key), extra_predictions(gold, pred, key))


def unaligned_rows(gold: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    """Missing and extra rows in one table; columns only one side has are null."""
    return missing_predictions(gold, pred, key).unionByName(
        extra_predictions(gold, pred, key), allowMissingColumns=True)


def attach_metrics(base: DataFrame, tables: Sequence[DataFrame | None], key: str = "sample_id") -> DataFrame:
    """Left-join per-sample metric tables. All share the key, so one partitioning serves the chain."""
    present = [t for t in tables if t is not None and len(t.columns) > 1]
    return reduce(lambda left, right: left.join(right, key, "left"), present, base)


def pair_runs(run_a: DataFrame, run_b: DataFrame, reference: str = "reference_narrative",
              key: str = "sample_id", check: bool = True) -> DataFrame:
    """One-to-one pairing of two runs that must cover the same ids with the same references."""
    def suffixed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col(key), *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != key],
                         F.lit(True).alias(f"_has_{tag}"))

    if check:
        require_unique(run_a, [key], "run a")
        require_unique(run_b, [key], "run b")
    both = suffixed(run_a, "a").join(suffixed(run_b, "b"), key, "full_outer")
    if check:
        faults = both.agg(
            F.count_if(F.col("_has_a").isNull() | F.col("_has_b").isNull()).alias("unpaired"),
            F.count_if(~F.col(f"{reference}_a").eqNullSafe(F.col(f"{reference}_b"))).alias("different"),
        ).first()
        if faults["unpaired"]:
            raise ValidationError("runs do not cover the same sample ids")
        if faults["different"]:
            raise ValidationError("reference texts differ between the runs")
    return both.drop("_has_a", "_has_b")


def pivot_conditions(scores: DataFrame, conditions: Sequence[str], by: Sequence[str] = ("sample_id",),
                     condition: str = "condition", value: str = "value", check: bool = True) -> DataFrame:
    """One column per condition; every row must have a value for every condition, exactly once."""
    wide = scores.groupBy(*by).pivot(condition, list(conditions)).agg(
        F.first(value).alias("value"), F.count(value).alias("rows"))
    if check:
        wrong = wide.where(" or ".join(f"coalesce(`{c}_rows`, 0) <> 1" for c in conditions)).take(1)
        if wrong:
            raise ValidationError(f"not one value per condition at {wrong[0]}")
    return wide.select(*by, *[F.col(f"{c}_value").alias(c) for c in conditions])


def shared_sources(left: DataFrame, right: DataFrame, source: str = "source_text", check: bool = True) -> DataFrame:
    """Rows of two test sets with the same normalised source, one to one.

    A shared source that one side repeats is an error; without ``check`` its first row counts. Keys are found
    from (digest, id) alone; texts are read only for the pairs.
    """
    def firsts(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(key_digest(F.col(source)).alias("_key")).agg(
            F.min("sample_id").alias(f"sample_id_{tag}"), F.count("*").alias(f"_n_{tag}"))

    def rows(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("sample_id", "emotion_label", "reference_narrative")])

    keyed = firsts(left, "left").join(firsts(right, "right"), "_key")
    if check:
        repeated = keyed.where("_n_left > 1 OR _n_right > 1").select("sample_id_left", "sample_id_right").take(5)
        if repeated:
            raise ValidationError(f"shared sources are repeated: {[tuple(r) for r in repeated]}")
    pairs = keyed.select("sample_id_left", "sample_id_right")
    return pairs.join(rows(left, "left"), "sample_id_left").join(rows(right, "right"), "sample_id_right")


def pair_table(runs: DataFrame, pairs: DataFrame, metrics: Sequence[str], run: str = "run", check: bool = True) -> DataFrame:
    """(pair, dataset, sample_id, ``<metric>_a``, ``<metric>_b``) for every row of ``pairs`` (pair, run_a, run_b, dataset).

    Both runs of a pair must cover the same samples of its dataset; otherwise it is an error.
    """
    def side(tag: str) -> DataFrame:
        named = pairs.select("pair", "dataset", F.col(f"run_{tag}").alias(run))
        return named.join(runs, [run, "dataset"]).select(
            "pair", "dataset", "sample_id", *[F.col(m).alias(f"{m}_{tag}") for m in metrics], F.lit(True).alias(f"_has_{tag}"))

    both = side("a").join(side("b"), ["pair", "dataset", "sample_id"], "full_outer")
    if check:
        alone = both.where("_has_a IS NULL OR _has_b IS NULL").select("pair", "dataset", "sample_id").take(5)
        if alone:
            raise ValidationError(f"only one run of the pair has {[tuple(r) for r in alone]}")
    return both.drop("_has_a", "_has_b")


def shared_source_summary(pairs: DataFrame, left_rows: int, right_rows: int) -> DataFrame:
    """Shared rows, their share of the smaller test set, and agreements of label and narrative."""
    return pairs.agg(
        (F.count("*") / F.lit(float(max(1, min(left_rows, right_rows))))).alias("share_of_smaller"),
        F.count("*").alias("shared_sources"),
        F.count_if(F.col("emotion_label_left") == F.col("emotion_label_right")).alias("label_agreements"),
        F.count_if(match_key(F.col("reference_narrative_left")) == match_key(F.col("reference_narrative_right")))
        .alias("narrative_agreements"),
    )


def common_samples(run_a: DataFrame, run_b: DataFrame, key: str = "sample_id", gold: str = "emotion_label",
                   pred: str = "predicted_emotion_label", check: bool = True) -> DataFrame:
    """Samples both models scored, with one gold label and two predictions."""
    a = run_a.select(key, F.trim(gold).alias("gold"), F.trim(pred).alias("pred_a"))
    b = run_b.select(key, F.trim(gold).alias("_gold_b"), F.trim(pred).alias("pred_b"))
    both = a.join(b, key)
    if check and both.where(~F.col("gold").eqNullSafe(F.col("_gold_b"))).take(1):
        raise ValidationError("gold labels differ between the runs")
    return both.drop("_gold_b")


def exclude_ids(tables: Sequence[DataFrame], excluded: DataFrame, key: str = "sample_id") -> list[DataFrame]:
    """Drop the excluded ids from every per-sample table."""
    ids = excluded.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in tables]


def generation_failures(pred: DataFrame) -> DataFrame:
    return pred.agg(F.count_if(~F.coalesce(F.col("parse_success"), F.lit(False))).alias("generation_failures"))


def completeness(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Gate for a prediction table: as many rows as gold and every parse succeeded."""
    failed = (~F.coalesce(F.col("parse_success"), F.lit(False))).cast("long")
    rows = pred.select(F.lit(1).alias("p"), failed.alias("f"), F.lit(0).alias("g")).unionAll(
        gold.select(F.lit(0), F.lit(0).cast("long"), F.lit(1)))
    counts = rows.agg(F.sum("p").alias("prediction_rows"), F.sum("f").alias("failed_rows"), F.sum("g").alias("gold_rows"))
    return counts.withColumn(
        "complete", (F.col("prediction_rows") == F.col("gold_rows")) & (F.col("failed_rows") == 0))


def agreement(pairs: DataFrame, sentences_of: Column, words_of: Column) -> DataFrame:
    """Exact-match rates of two backends and the length profile of the first."""
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted_emotion_label_a") == F.col("predicted_emotion_label_b")).cast("double"))
        .alias("label_exact_match"),
        F.count_if(F.col("predicted_emotion_label_a") != F.col("predicted_emotion_label_b")).alias("label_differences"),
        F.avg((F.trim("predicted_narrative_a") == F.trim("predicted_narrative_b")).cast("double"))
        .alias("narrative_exact_match"),
        F.avg(words_of).alias("words_mean"),
        F.percentile(words_of, F.lit(0.95)).alias("words_p95"),
        F.max(sentences_of).alias("max_sentences"),
    )


def union_metrics(tables: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t for t in tables if t is not None])


def union_corpora(parts: Sequence[tuple[str, DataFrame]], text: str, expected_rows: int | None = None) -> DataFrame:
    """Concatenate corpora after dropping blank texts; optionally insist on the total size."""
    cleaned = [
        df.select(F.lit(name).alias("corpus"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        .where("text <> ''") for name, df in parts
    ]
    result = reduce(DataFrame.unionAll, cleaned)
    if expected_rows is not None and (rows := result.count()) != expected_rows:
        raise ValidationError(f"expected {expected_rows} rows, found {rows}")
    return result


def shared_keys(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct intersection, by digest so only 64 characters per row are shuffled."""
    key = key_digest(F.col(column)).alias("key")
    return left.select(key).intersect(right.select(key))


def unknown_values(df: DataFrame, column: str, vocabulary: DataFrame, name: str = "label") -> DataFrame:
    return df.select(F.col(column).alias("value")).subtract(vocabulary.select(F.col(name).alias("value")))


def label_union(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.select(F.col(gold).alias("label")).union(df.select(F.col(pred).alias("label"))).distinct()


def manual_sheet(df: DataFrame, sample_size: int, label_count: int, label: str = "emotion_label",
                 key: str = "sample_id") -> DataFrame:
    """Review sheet: the first rows of every label, capped overall, with blank answer columns."""
    from narralytics.operators.ranking import top_per_group

    per_label = max(1, sample_size // max(1, label_count))
    rows = top_per_group(df.where(F.col(label).isNotNull()), [label], [F.col(key)], per_label)
    picked = rows.orderBy(label, key).limit(sample_size)
    blank = [F.lit("").alias(c) for c in ("manual_relevance", "manual_grammar", "notes")]
    return picked.select(key, "source_text", "reference_narrative", "predicted_narrative", *blank)


