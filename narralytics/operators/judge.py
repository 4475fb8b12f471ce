"""Judge, argument and manual-review summaries, and the content-addressed score cache."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.functions.text import safe_number
from narralytics.session import stored


def _means(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[F.avg(c).alias(name) for name, c in columns.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in columns])).alias("r")).select("r.*")


def judge_summary(scores: DataFrame) -> DataFrame:
    return _means(scores, {f"judge_{n}_mean": F.col(f"{n}_score") for n in ("relevance", "faithfulness", "coherence")})


def argument_summary(results: DataFrame) -> DataFrame:
    return _means(results, {f"argument_{n}_rate": F.col(c).cast("double") for n, c in
                            (("claim", "has_claim"), ("reason", "has_reason"), ("stance", "has_stance_marker"))})


def manual_summary(sheet: DataFrame) -> DataFrame:
    """Means of hand-entered scores; text that is not a number is ignored."""
    return _means(sheet, {f"{c}_mean": safe_number(F.col(c)) for c in ("manual_relevance", "manual_grammar")})


def cache_key(sample_id: Column, model: str, prompt_version: str, *content: Column) -> Column:
    """Key of a cached score. The content is part of it, so a changed text is scored again."""
    digest = F.sha2(F.concat_ws("\u0001", *content), 256)
    return F.sha2(F.concat_ws(":", sample_id.cast("string"), F.lit(model), F.lit(prompt_version), digest), 256)


def cached_scores(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with their scores, misses still to be scored). Of a repeated key the cache's smallest row counts."""
    others = [c for c in cache.columns if c != key]
    once = cache.groupBy(key).agg(F.min(F.struct(*others)).alias("_s")).select(key, "_s.*")
    return rows.join(once, key), rows.join(once.select(key), key, "left_anti")


def score_with_cache(rows: DataFrame, cache: DataFrame, score, key: str = "cache_key", append_to: str | None = None) -> DataFrame:
    """Hits from the cache, misses through ``score`` (a DataFrame function that adds the cache columns).

    New scores are computed once and, with ``append_to``, added to the cache table at that path.
    """
    hits, misses = cached_scores(rows, cache, key)
    new = stored(score(misses).select(*hits.columns), "new-scores")
    if append_to is not None:
        new.select(*cache.columns).dropDuplicates([key]).write.mode("append").parquet(append_to)
    return hits.unionByName(new)
