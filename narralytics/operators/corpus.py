"""Corpus filters, narrative ratios, topic tags and retention studies."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.constants import (
    FIRST_PERSON_GRID, FIRST_PERSON_THRESHOLD, MIN_WORD_COUNT, PAST_GRID, PAST_THRESHOLD,
)
from narralytics.functions.plugins import RuleTagger
from narralytics.functions.text import clean_markup, collapse_without_urls, safe_int, safe_number, tag_topics, word_count
from narralytics.operators.ranking import first_by_ordinal, percentiles
from narralytics.session import cut_lineage, with_once


def long_documents(df: DataFrame, text: str = "text", min_words: int = MIN_WORD_COUNT) -> DataFrame:
    """Normalised, non-empty documents with more than ``min_words`` words.

    A ``word_count`` column that is already there is parsed and trusted; bad values count as 0.
    """
    clean = df.withColumn(text, collapse_without_urls(F.col(text))).where(F.col(text) != "")
    counted = safe_int(F.col("word_count")) if "word_count" in df.columns else word_count(F.col(text))
    return clean.withColumn("word_count", counted).where(F.col("word_count") > min_words)


def sequential_sample(df: DataFrame, ordinal: str, rows: int | None = None, text: str = "text",
                      min_words: int = MIN_WORD_COUNT) -> DataFrame:
    """The first ``rows`` long documents in ordinal order (all by default); rows with a bad count are skipped."""
    words = safe_number(F.col("word_count")) if "word_count" in df.columns else word_count(F.col(text))
    keep = (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (words.cast("long") > min_words)
    return df.where(keep) if rows is None else first_by_ordinal(df.where(keep), ordinal, rows)


def narrative_ratios(df: DataFrame, text: str = "text", tagger=None) -> DataFrame:
    """Adds ``past_verb_ratio``, ``first_person_ratio`` and ``word_count``; token-free rows are dropped."""
    counted = (tagger or RuleTagger()).add_counts(df, text).where("tokens > 0")
    return (counted
            .withColumn("past_verb_ratio", F.when(F.col("verbs") > 0, F.col("past_verbs") / F.col("verbs")).otherwise(0.0))
            .withColumn("first_person_ratio", F.col("first_person") / F.col("tokens"))
            .withColumn("word_count", word_count(F.col(text)))
            .drop("verbs", "past_verbs", "first_person", "tokens"))


def is_narrative(past: float = PAST_THRESHOLD, first_person: float = FIRST_PERSON_THRESHOLD) -> Column:
    return (F.col("past_verb_ratio") > past) & (F.col("first_person_ratio") > first_person)


def narrative_filter(df: DataFrame, text: str = "text", tagger=None, past: float = PAST_THRESHOLD,
                     first_person: float = FIRST_PERSON_THRESHOLD) -> DataFrame:
    return narrative_ratios(df, text, tagger).where(is_narrative(past, first_person))


def tag_documents(df: DataFrame, rules: Sequence[tuple[str, str]], text: str = "text", require_topic: bool = False) -> DataFrame:
    tagged = with_once(df, topics=tag_topics(clean_markup(F.col(text)), rules))
    return tagged.where("topics <> ''") if require_topic else tagged


def select_topics(assignments: DataFrame, topics: DataFrame, ordinal: str) -> DataFrame:
    """Rows of the chosen topics, ordered by topic and ordinal."""
    return assignments.join(topics.select("topic_id").distinct(), "topic_id", "left_semi").orderBy("topic_id", ordinal)


def retention_summary(ratios: DataFrame, past: float = PAST_THRESHOLD, first_person: float = FIRST_PERSON_THRESHOLD) -> DataFrame:
    """Pass rates, means and exact medians of the two ratios.

    Tagging is the expensive part, so the two ratio columns are written once and read back.
    """
    ratios = cut_lineage(ratios.select("past_verb_ratio", "first_person_ratio"))
    keep_past, keep_first = F.col("past_verb_ratio") > past, F.col("first_person_ratio") > first_person
    rates = ratios.agg(
        F.count("*").alias("n"), F.avg(keep_past.cast("double")).alias("pass_past"),
        F.avg(keep_first.cast("double")).alias("pass_fp"), F.avg((keep_past & keep_first).cast("double")).alias("pass_both"),
        F.avg("past_verb_ratio").alias("past_mean"), F.avg("first_person_ratio").alias("fp_mean"))
    found = {r["column"]: r["p0"] for r in percentiles(ratios, ["past_verb_ratio", "first_person_ratio"], [0.5]).collect()}  # two rows
    return rates.withColumn("past_median", F.lit(found.get("past_verb_ratio")).cast("double")).withColumn(
        "fp_median", F.lit(found.get("first_person_ratio")).cast("double"))


def retention_sweep(ratios: DataFrame, past_grid: Sequence[float] = tuple(PAST_GRID),
                    first_grid: Sequence[float] = tuple(FIRST_PERSON_GRID), past: float = PAST_THRESHOLD,
                    first_person: float = FIRST_PERSON_THRESHOLD) -> DataFrame:
    """Share kept while one threshold moves and the other stays; one scan, one aggregate row."""
    points = [("past", p, first_person, p) for p in past_grid] + [("first_person", past, f, f) for f in first_grid]
    rates = [F.avg(is_narrative(p, f).cast("double")).alias(f"r{i}") for i, (_, p, f, _) in enumerate(points)]
    return ratios.agg(*rates).select(F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), F.lit(float(value)).alias("threshold"), F.col(f"r{i}").alias("retention"))
        for i, (axis, _, _, value) in enumerate(points)])).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts on [low, high]; the last bin includes its right edge, empty bins are 0."""
    inside = df.where(F.col(column).between(low, high))
    bucket = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    counts = inside.groupBy(bucket.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def topic_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("topic_id").agg(F.count("*").alias("comment_count")).orderBy("topic_id")
