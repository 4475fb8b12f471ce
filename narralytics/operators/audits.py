"""Leakage audits and fingerprints."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.functions.draws import hash_hex
from narralytics.functions.text import collapse, key_digest

# fixed values: the six split pairs of the overlap audit; the last one is reported but not gated
SPLIT_PAIRS = [
    ("train", "validation"), ("train", "stage1"), ("validation", "stage1"),
    ("train", "manual"), ("validation", "manual"), ("stage1", "manual"),
]
# fixed values: what must share nothing for training to count as free of leakage
GATED = [(f"{a}_vs_{b}", kind) for a in ("train", "validation") for b in ("stage1", "manual") for kind in ("source", "narrative")]
GATED.append(("train_vs_validation", "source"))


def value_digests(splits: DataFrame) -> DataFrame:
    """(split, kind, key) of source and narrative; blank values are left out."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
                      for kind, col in (("source", "source_text"), ("narrative", "reference_narrative"))])
    long = splits.select("split", F.explode(kinds).alias("k")).where(collapse(F.col("k.value")) != "")
    return long.select("split", "k.kind", key_digest(F.col("k.value")).alias("key"))


def overlap_audit(splits: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(SPLIT_PAIRS)) -> DataFrame:
    """Distinct shared values per split pair. One aggregation records in which splits a value occurs;
    no value is joined with its copies."""
    names = sorted({s for pair in pairs for s in pair})
    keys = value_digests(splits).groupBy("kind", "key").agg(
        *[F.max(F.col("split") == s).alias(s) for s in names])
    sums = keys.groupBy("kind").agg(*[
        F.count_if(F.col(a) & F.col(b)).alias(f"{a}_vs_{b}") for a, b in pairs])
    return sums.select("kind", F.explode(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"{a}_vs_{b}").alias("shared")) for a, b in pairs])).alias("p")
    ).select("kind", "p.*")


def leakage_passed(audit: DataFrame, gated: Sequence[tuple[str, str]] = tuple(GATED)) -> DataFrame:
    """True when no gated (pair, kind) shares a value; an audit that lacks one of them is an error."""
    row = F.struct("pair", "kind").isin([F.struct(F.lit(p), F.lit(k)) for p, k in gated])
    found = audit.agg(F.count_if(row).alias("n"), F.sum(F.when(row, F.col("shared"))).alias("shared"))
    absent = F.raise_error(F.lit("the audit lacks a gated pair")).cast("boolean")
    return found.select(F.when(F.col("n") == len(set(gated)), F.col("shared") == 0).otherwise(absent).alias("training_leakage_passed"))


def order_free_print(value: Column) -> Column:
    """Fingerprint of a multiset of strings as the sum of 48-bit hashes."""
    return F.sum(F.conv(F.substring(F.md5(value), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


def ordered_print(value: Column, ordinal: Column) -> Column:
    """Order-sensitive fingerprint: the ordinal is hashed with the value."""
    return F.sum(F.conv(F.substring(hash_hex(ordinal, value), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


def split_fingerprints(splits: DataFrame) -> DataFrame:
    """Rows, distinct sources, distinct narratives and their prints, per split."""
    counted = value_digests(splits).groupBy("split", "kind", "key").agg(F.count("*").alias("n"))
    number = F.conv(F.substring("key", 1, 12), 16, 10).cast("decimal(38,0)") * F.col("n")
    of = lambda kind, v: F.when(F.col("kind") == kind, v)
    return counted.groupBy("split").agg(
        F.sum(of("source", F.col("n"))).alias("rows"),
        F.count(of("source", F.col("key"))).alias("unique_sources"),
        F.count(of("narrative", F.col("key"))).alias("unique_narratives"),
        F.sum(of("source", number)).cast("string").alias("source_print"),
        F.sum(of("narrative", number)).cast("string").alias("narrative_print"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Rows, size and an order-free print of the rows of every Parquet file under a path.

    The print is a sum over rows, so a large file is read by as many tasks as it has splits.
    """
    table = spark.read.parquet(path)
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns])
    return table.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("length"), row.alias("row")).groupBy(
        "file", "length").agg(F.count("*").alias("rows"), order_free_print(F.col("row")).alias("content_print"))
