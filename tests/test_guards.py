"""Errors instead of silent nulls, cuts and repeats."""
import pytest
from pyspark.sql import functions as F

from narralytics.constants import EMOTION_LABELS
from narralytics.functions import kernels
from narralytics.operators import align as A
from narralytics.operators import audits as U
from narralytics.operators import generation as G
from narralytics.operators import judge as J
from narralytics.operators import label_metrics as L
from narralytics.operators import runs as R
from narralytics.operators import stats as S
from narralytics.operators.align import ValidationError
from narralytics.functions.plugins import StatisticalTagger
from narralytics.operators.corpus import narrative_ratios
from narralytics.plans.evaluation import evaluate


def test_grid_stops_above_the_limit(spark):
    cells = spark.range(L.MAX_MATRIX_LABELS + 1).select(F.col("id").cast("string").alias("gold"), F.lit("0").alias("pred"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="more than 1000 labels"):
        L.confusion_grid(cells).count()
    assert L.confusion_grid(cells.limit(40)).count() >= 1600


def test_null_labels_count_as_empty_ones(spark):
    rows = spark.createDataFrame([("Joy", "Joy"), ("Joy", None), (None, None)], f"{L.GOLD} string, {L.PRED} string")
    assert L.accuracy(rows).first()["accuracy"] == pytest.approx(2 / 3)
    assert sum(r["n"] for r in L.confusion_grid(L.cell_counts(rows)).collect()) == 3
    flags = L.correctness(rows.withColumn("sample_id", F.monotonically_increasing_id())).select("emotion_correct").collect()
    assert sorted(r[0] for r in flags) == [False, True, True]


def test_exact_sign_flip_refuses_many_seeds(spark):
    rows = spark.createDataFrame([("d", "m", i, 1.0, 0.0, 1.0) for i in range(41)], "dataset string, metric string, seed int, treatment double, control double, advantage double")
    with pytest.raises(Exception, match="at most 40 seeds"):
        S.paired_tests(rows).collect()


def test_seed_with_one_condition_is_an_error(spark):
    rows = spark.createDataFrame([("d", "m", "a", 1, 1.0), ("d", "m", "b", 1, 0.5), ("d", "m", "a", 2, 1.0)], "dataset string, metric string, condition string, seed int, value double")
    with pytest.raises(Exception, match="seed without both conditions: 2"):
        S.seed_advantages(rows, "a", "b").collect()


def test_verdict_needs_the_asked_number_of_wins(spark):
    rows = spark.createDataFrame([("treatment",), ("none",), ("none",)], "favored string")
    assert [S.verdict(rows, min_wins=n).first()["verdict"] for n in (1, 2)] == ["partial_improvement", "no_clear_difference"]


def test_unconverged_fraction_raises():
    with pytest.raises(ArithmeticError):
        kernels.beta_cdf(500.0, 500.0, 0.49, terms=3)
    assert 0.2 < kernels.beta_cdf(500.0, 500.0, 0.49) < 0.3


def test_leakage_gate_refuses_an_incomplete_audit(spark):
    full = spark.createDataFrame([(k, p, 0) for p, k in U.GATED], "kind string, pair string, shared long")
    assert U.leakage_passed(full).first()[0] is True
    leaking = full.unionByName(full.limit(0)).withColumn("shared", F.when((F.col("kind") == "source") & (F.col("pair") == "train_vs_manual"), 1).otherwise(0))
    assert U.leakage_passed(leaking).first()[0] is False
    for bad in (full.limit(0), full.where("pair <> 'train_vs_manual'")):
        with pytest.raises(Exception, match="lacks a gated pair"):
            U.leakage_passed(bad).collect()
    other = full.limit(1)
    assert U.leakage_passed(other, [(other.first()["pair"], other.first()["kind"])]).first()[0] is True


def test_recheck_sees_one_sided_and_undefined_metrics(spark):
    of = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    stored = of([("a", 1.0), ("b", 2.0)])
    assert R.check_summary(of([("a", 1.0), ("b", 2.0)]), stored).first()["equal"]
    for wrong in ([("a", 1.0)], [("a", 1.0), ("b", 2.0), ("c", 1.0)], [("a", 1.0), ("b", float("nan"))], [("a", 1.0), ("b", 2.1)]):
        row = R.check_summary(of(wrong), stored).first()
        assert not row["equal"] and row["metrics"] >= 2
    with pytest.raises(Exception, match="no metric to compare"):
        R.check_summary(of([]), of([])).collect()


def test_checkpoint_by_name_or_an_error(spark):
    history = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("s", 1, 0.9), ("s", 3, 0.1)], "run string, step long, eval_loss double")
    pick = lambda **options: {r["run"]: r["selected_step"] for r in R.select_checkpoint(history, **options).collect()}
    assert pick() == {"r": 2, "s": 3}
    assert pick(named=spark.createDataFrame([("r", 1)], "run string, step long")) == {"r": 1, "s": 3}
    runs = spark.createDataFrame([("r",), ("t",)], "run string")
    with pytest.raises(ValidationError, match="t"):
        pick(runs=runs)
    with pytest.raises(ValidationError, match="r"):
        pick(named=spark.createDataFrame([("r", 7)], "run string, step long"), runs=runs.where("run = 'r'"))


def test_record_in_both_phases(spark):
    rows = spark.createDataFrame([(1, "evaluating"), (0, "idle"), (None, "evaluating"), (2, None)], "training_running int, evaluation_phase string")
    assert sorted(r["phase"] for r in R.with_phases(rows).collect()) == ["evaluation", "evaluation", "training", "training"]


def test_shared_sources_are_one_to_one(spark):
    side = lambda rows: spark.createDataFrame([(i, t, "Joy", t) for i, t in rows], "sample_id long, source_text string, emotion_label string, reference_narrative string")
    left, right = side([(1, "a"), (2, "b"), (3, "a")]), side([(7, "A "), (8, "c")])
    with pytest.raises(ValidationError, match="repeated"):
        A.shared_sources(left, right)
    pairs = A.shared_sources(left, right, check=False)
    assert [(r["sample_id_left"], r["sample_id_right"]) for r in pairs.collect()] == [(1, 7)]
    row = A.shared_source_summary(pairs, 3, 2).first()
    assert row["share_of_smaller"] == 0.5 and row["shared_sources"] == row["label_agreements"] == row["narrative_agreements"] == 1


def test_pair_table(spark):
    runs = spark.createDataFrame([("x", "d", 1, 0.1), ("x", "d", 2, 0.2), ("y", "d", 1, 0.3), ("y", "d", 2, 0.4), ("z", "d", 1, 0.5)], "run string, dataset string, sample_id long, m double")
    pairs = spark.createDataFrame([("p", "x", "y", "d"), ("q", "y", "x", "d")], "pair string, run_a string, run_b string, dataset string")
    got = sorted(tuple(r) for r in A.pair_table(runs, pairs, ["m"]).collect())
    assert got == [("p", "d", 1, 0.1, 0.3), ("p", "d", 2, 0.2, 0.4), ("q", "d", 1, 0.3, 0.1), ("q", "d", 2, 0.4, 0.2)]
    with pytest.raises(ValidationError, match="only one run"):
        A.pair_table(runs, spark.createDataFrame([("p", "x", "z", "d")], pairs.schema), ["m"])


def counting_client(path):
    """A client that leaves a line in a file for every call."""
    def make():
        def call(prompt):
            with open(path, "a") as log:
                log.write(prompt + "\n")
            return '{"predicted_narrative": "n", "predicted_emotion_label": "' + EMOTION_LABELS[0] + '"}', "stop"
        return call
    return make


def test_every_request_is_sent_once(spark, tmp_path):
    log = tmp_path / "calls"
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "sample_id long, prompt string")
    out = G.generate_predictions(rows, "prompt", counting_client(str(log)), "m", "r")
    assert out.count() == out.where("parse_success").count() == 20
    assert sorted(log.read_text().split()) == sorted(f"p{i}" for i in range(20))


def test_cache_grows_and_repeated_keys_count_once(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "calls"
    spark.createDataFrame([("k0", 5), ("k0", 4)], "cache_key string, score int").write.parquet(path)
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(4)], "sample_id long, cache_key string")
    make = counting_client(str(log))

    def score(misses):
        asked = G.request_rows(misses, "cache_key", make)
        return misses.join(asked, "sample_id").select("sample_id", "cache_key", F.lit(1).alias("score"))

    for calls in (3, 3):
        cache = spark.read.parquet(path)
        got = J.score_with_cache(rows, cache, score, append_to=path)
        assert sorted((r["sample_id"], r["score"]) for r in got.collect()) == [(0, 4), (1, 1), (2, 1), (3, 1)]
        assert len(log.read_text().split()) == calls


def test_run_summary_counts_parse_failures(spark):
    gold = spark.createDataFrame([(1, "s", "Joy", "n"), (2, "s", "Fear", "n")], "sample_id long, source_text string, emotion_label string, reference_narrative string")
    pred = spark.createDataFrame([(1, "n", "Joy", True), (2, "", "", False)], "sample_id long, predicted_narrative string, predicted_emotion_label string, parse_success boolean")
    summary = {r["metric"]: r["value"] for r in evaluate(gold, pred, overlap=False, semantic=False).summary.collect()}
    assert summary["num_generation_failures"] == 1 and summary["accuracy"] == 0.5


def test_learned_tagger_adapter(spark):
    def make():
        return lambda texts: [[(w, "PAST" if w.endswith("ed") else "VERB" if w == "go" else "OTHER") for w in t.split()] for t in texts]
    df = spark.createDataFrame([(1, "I walked and we go"), (2, "")], "id long, text string")
    rows = narrative_ratios(df, tagger=StatisticalTagger(make, {"PAST", "VERB"}, {"PAST"})).collect()
    assert [(r["id"], r["past_verb_ratio"], r["first_person_ratio"]) for r in rows] == [(1, 0.5, 0.4)]
