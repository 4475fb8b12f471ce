"""Trees of digests over ranked blocks of a table: they tell where two tables differ.

Rows are ranked by a unique numeric key and cut into blocks of ``leaf_rows``; a block's digest is that of its rows' digests in order, a block of the next level digests
``fan`` blocks below. Every level is a written table. Two trees are compared from the top: of a block that differs only
the children are read, so one changed row costs one block of ``fan`` digests per level, whatever the size of the tables.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.operators.ranking import rank_by_value
from narralytics.session import scratch_path, stored

LEAF_ROWS, FAN = 256, 16
NODE = "block long, rows long, first_key long, last_key long, digest string"


@dataclass(frozen=True)
class MerkleTree:
    path: str
    levels: int         # level 0 holds the blocks of rows, the last one the root
    leaf_rows: int
    fan: int

    def level(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.schema(NODE).parquet(f"{self.path}/level={number}")


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of a row's values; nulls differ from empty strings."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _digested(pairs: Column) -> Column:
    """Digest of the digests of (place, digest) pairs in order of place."""
    return F.sha2(F.array_join(F.transform(F.sort_array(pairs), lambda p: p["digest"]), ""), 256)


def merkle_tree(df: DataFrame, key: str, columns: Sequence[str] | None = None, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> MerkleTree:
    """Builds and writes the levels over the columns (all of them by default); ``key`` is unique and numeric."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "merkle")
    rows = df.select(F.col(key).cast("long").alias("_key"), row_digest(columns or df.columns).alias("digest"))
    ranked = rank_by_value(rows, "_key", out="_rank")
    place = F.col("_rank") - 1
    block = F.floor(place / leaf_rows).cast("long")
    level = ranked.groupBy(block.alias("block")).agg(      # at most ``leaf_rows`` digests a block
        F.count("*").alias("rows"), F.min("_key").alias("first_key"), F.max("_key").alias("last_key"),
        _digested(F.collect_list(F.struct(place.alias("place"), "digest"))).alias("digest"))
    number = 0
    while True:
        level.write.parquet(f"{path}/level={number}")
        level = spark.read.schema(NODE).parquet(f"{path}/level={number}")
        number += 1
        if level.limit(2).count() < 2:
            return MerkleTree(path, number, leaf_rows, fan)
        level = level.groupBy(F.floor(F.col("block") / fan).cast("long").alias("block")).agg(
            F.sum("rows").alias("rows"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
            _digested(F.collect_list(F.struct(F.col("block").alias("place"), "digest"))).alias("digest"))


def differing_ranges(spark: SparkSession, a: MerkleTree, b: MerkleTree, report: list[int] | None = None) -> DataFrame:
    """(block, first_rank, last_rank, first_key_a, last_key_a, first_key_b, last_key_b) of the blocks of rows that differ.

    Keys are null where a table has no such block. ``report`` receives the number of digests looked at per level, from the top.
    """
    if (a.leaf_rows, a.fan) != (b.leaf_rows, b.fan):
        raise ValueError("the trees have different blocks")
    wanted: DataFrame | None = None
    for number in range(min(a.levels, b.levels) - 1, -1, -1):
        sides = []
        for tree, name in ((a, "a"), (b, "b")):
            level = tree.level(spark, number)
            if wanted is not None:
                level = level.join(wanted, "block", "left_semi")
            sides.append(level.select("block", *[F.col(c).alias(f"{c}_{name}") for c in ("rows", "first_key", "last_key", "digest")]))
        both = stored(sides[0].join(sides[1], "block", "full"), "merkle-level")
        if report is not None:
            report.append(both.count())
        differ = both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        if not differ.limit(1).count():
            break
        wanted = differ.select((F.col("block") * a.fan).alias("_low")).select(F.explode(F.sequence(F.col("_low"), F.col("_low") + a.fan - 1)).alias("block"))
    first = F.col("block") * a.leaf_rows + 1
    return differ.select("block", first.alias("first_rank"), (first - 1 + F.greatest(F.coalesce("rows_a", F.lit(0)), F.coalesce("rows_b", F.lit(0)))).alias("last_rank"),
                         "first_key_a", "last_key_a", "first_key_b", "last_key_b")
