"""Trees of digests: what they find and how little they read."""
import pytest
from pyspark.sql import functions as F

from narralytics.operators.merkle import differing_ranges, merkle_tree


def rows(spark, n):
    return spark.range(n).select((F.col("id") * 3).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("note"))


def ranges(spark, a, b, report=None, **options):
    got = differing_ranges(spark, merkle_tree(a, "id", **options), merkle_tree(b, "id", **options), report).collect()
    return sorted((r.first_rank, r.last_rank, r.first_key_a, r.last_key_a, r.first_key_b, r.last_key_b) for r in got)


def test_one_changed_row_of_ten_thousand_is_found_by_one_block_per_level(spark):
    a = rows(spark, 10_000)
    b = a.withColumn("text", F.when(F.col("id") == 3 * 7777, "other").otherwise(F.col("text"))).repartition(5)
    report = []
    assert ranges(spark, a, b, report, leaf_rows=16, fan=8) == [(7777 // 16 * 16 + 1, 7777 // 16 * 16 + 16) + (7777 // 16 * 48, 7777 // 16 * 48 + 45) * 2]
    assert len(report) == 5 and report[0] == 1 and max(report) <= 8      # 625, 79, 10, 2 and 1 blocks


@pytest.mark.parametrize("n, m", [(0, 0), (1, 1), (500, 500), (500, 503), (30, 500), (0, 40)])
def test_equal_tables_and_further_rows(spark, n, m):
    got = ranges(spark, rows(spark, n), rows(spark, m).orderBy(F.desc("id")), leaf_rows=10, fan=4)
    blocks = [k for k in range(-(-max(n, m) // 10)) if n != m and (k + 1) * 10 > min(n, m)]
    assert [g[:2] for g in got] == [(k * 10 + 1, min(k * 10 + 10, max(n, m))) for k in blocks]
    for g, k in zip(got, blocks):
        assert (g[2] is None) == (k * 10 >= n) and (g[4] is None) == (k * 10 >= m)


def test_null_is_not_the_empty_string(spark):
    a = rows(spark, 20)
    assert ranges(spark, a, a.withColumn("note", F.when(F.col("id") != 6, F.col("note")).otherwise("")), leaf_rows=1, fan=2) == [(3, 3, 6, 6, 6, 6)]
