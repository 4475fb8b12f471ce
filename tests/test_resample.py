import numpy as np
import pytest
from pyspark.sql import functions as F

from narralytics.operators import resample as R


def rows(spark, n=300, groups=("a", "b")):
    rng = np.random.default_rng(4)
    data = [(g, i, float(rng.normal(k, 1))) for k, g in enumerate(groups) for i in range(n)]
    return spark.createDataFrame(data, "g string, sample_id long, v double")


def test_drawn_and_block_sums_agree_in_distribution(spark):
    stats = R.indexed(rows(spark), "sample_id", ["g"])
    drawn = R.resampled_sums(stats, ["v"], ["g"], 400, 1, portable=True).toPandas()
    blocks = R.block_sums(stats, ["v"], ["g"], 400, 1, block_rows=70).toPandas()
    for part in (drawn, blocks):
        assert (part["draws"] == 300).all() and len(part) == 800
    for g in "ab":
        a, b = drawn[drawn.g == g]["v"] / 300, blocks[blocks.g == g]["v"] / 300
        assert a.mean() == pytest.approx(b.mean(), abs=0.02) and a.std() == pytest.approx(b.std(), rel=0.2)
    again = R.block_sums(stats, ["v"], ["g"], 400, 1, block_rows=70).toPandas()
    assert sorted(blocks["v"].round(9)) == sorted(again["v"].round(9))


def test_results_do_not_depend_on_a_size_limit(spark, monkeypatch):
    stats = R.indexed(rows(spark, 50), "sample_id", ["g"])
    get = lambda portable: sorted(map(tuple, R.resampled_sums(stats, ["v"], ["g"], 20, 1, portable).collect()))
    before = get(False), get(True)
    monkeypatch.setattr(R, "BROADCAST_VALUES", 0)
    after = get(False), get(True)
    for a, b in zip(before, after):
        assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 40
        assert [r[2:] for r in a] == [pytest.approx(r[2:]) for r in b]


def test_rows_with_a_null_group_are_resampled(spark):
    stats = R.indexed(rows(spark, 30, ("a", None)), "sample_id", ["g"])
    assert R.resampled_sums(stats, ["v"], ["g"], 5, 1).where("g IS NULL AND draws = 30").count() == 5


def label_pairs(spark, n=400):
    rng = np.random.default_rng(8)
    names = ["Anger", "Fear", "Joy"]
    data = []
    for s in (1, 2, 3):
        for i in range(n):
            g = names[int(rng.integers(3))]
            data.append(("d", s, i, g, g if rng.random() < 0.6 else "Joy", g if rng.random() < 0.75 else ""))
    return spark.createDataFrame(data, "dataset string, seed int, sample_id long, gold string, pred_a string, pred_b string")


@pytest.mark.parametrize("hierarchical", [False, True])
def test_label_bootstrap_paths_agree(spark, hierarchical):
    pairs = label_pairs(spark)
    run = (lambda portable: R.hierarchical_label_bootstrap(pairs, samples=150, portable=portable)) if hierarchical else (
        lambda portable: R.label_bootstrap(pairs.where("seed = 1"), ["dataset"], 300, portable=portable))
    exact, cells = ({r["metric"]: r for r in run(portable).collect()} for portable in (True, False))
    for metric in ("accuracy", "macro_f1"):
        assert exact[metric]["difference"] == pytest.approx(cells[metric]["difference"])
        assert exact[metric]["ci_95_low"] == pytest.approx(cells[metric]["ci_95_low"], abs=0.03)
        assert exact[metric]["ci_95_low"] < exact[metric]["difference"] < exact[metric]["ci_95_high"]


def test_constant_difference_is_degenerate(spark):
    df = spark.range(20).select(F.col("id").alias("sample_id"), F.lit(0.7).alias("m_a"), F.lit(0.5).alias("m_b"))
    row = R.paired_bootstrap(df, {"rougeL_mean": "m"}, samples=50, bleu=False).first()
    assert row["ci_95_low"] == pytest.approx(0.2) and row["ci_95_high"] == pytest.approx(0.2)
    assert row["favored"] == "model_a" and row["p_value"] == pytest.approx(2 / 51)
    lower = R.paired_bootstrap(df, {"normalized_dtw_distance_mean": "m"}, samples=50, bleu=False).first()
    assert lower["favored"] == "model_b"


def test_one_row_one_replicate(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0)], "sample_id long, m_a double, m_b double")
    row = R.paired_bootstrap(df, {"x": "m"}, samples=1, bleu=False).first()
    assert row["p_value"] == 1.0 and not row["significant_95"]


def test_draws_from_a_larger_table_are_not_broadcast(spark):
    n = 130_000
    stats = spark.range(n).selectExpr("'a' AS g", "id AS idx", "IF(id % 10 = 0, NULL, CAST(id % 7 AS double)) AS v", "CAST(id % 3 AS int) AS w")
    sums = R.resampled_sums(stats, ["v", "w"], ["g"], 3, 1, portable=True)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan
    reps = R.replicates(R.group_sizes(stats, ["g"]), 3, ["g"]).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    draw = R.draw_index(F.col("n"), 1, F.col("g"), F.col("replicate"), F.col("slot"), portable=True)
    want = reps.withColumn("idx", draw).join(stats, ["g", "idx"]).groupBy("g", "replicate").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.count("*").alias("draws"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect()))
    assert dict(sums.dtypes) == dict(want.dtypes)
