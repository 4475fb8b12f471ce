import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from narralytics.operators import align as A
from narralytics.operators import audits as U
from narralytics.operators import corpus as C
from narralytics.operators import generation as G
from narralytics.operators import judge as J
from narralytics.operators import label_metrics as L
from narralytics.operators import overlap_metrics as O
from narralytics.operators import parsing as P
from narralytics.operators import prep
from narralytics.operators import ranking as K
from narralytics.operators import runs as R
from narralytics.operators import semantic as M
from narralytics.operators import similarity as N
from narralytics.operators import stats as S
from narralytics.operators import topics as T


# --- ranking ---------------------------------------------------------------------------------

def test_ranks_are_whole_and_ordered(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("g"))
    by_hash = K.rank_by_hash(df, ["id"], 7, ["g"]).toPandas()
    for _, part in by_hash.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    by_value = K.rank_by_value(df, "id").toPandas().sort_values("id")
    assert list(by_value["rank"]) == list(range(1, 5001))


def test_null_group_is_ranked(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    assert {(r["id"], r["rank"]) for r in K.rank_by_value(df, "id", ["g"]).collect()} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [0.0] * 400 + list(range(300)), [x * x % 97 / 7 for x in range(1000)]])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = K.exact_percentiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.95, 1.0])))


def test_percentiles_of_groups_and_columns(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324], [7.25] * 200])
    b = rng.integers(-5, 6, len(a))
    g = [None if i % 5 == 0 else f"g{i % 3}" for i in range(len(a))]
    rows = [(g[i], float(a[i]), None if i % 7 == 0 else int(b[i])) for i in range(len(a))] + [("empty", None, None), ("one", 3.0, None)]
    df = spark.createDataFrame(rows, "g string, a double, b int").repartition(5)
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["g"], r["column"]): r[2:] for r in K.percentiles(df, ["a", "b"], ps, ["g"]).collect()}
    assert ("empty", "a") not in got and ("one", "b") not in got and got["one", "a"] == (3.0,) * 5
    for key in [None, "g0", "g1", "g2"]:
        for i, name in ((1, "a"), (2, "b")):
            values = sorted(float(r[i]) for r in rows if r[0] == key and r[i] is not None)
            at = [(len(values) - 1) * p for p in ps]
            pairs = [(values[int(np.floor(x))], values[int(np.ceil(x))], x - np.floor(x)) for x in at]
            assert got[key, name] == pytest.approx([lo if lo == hi else lo + f * (hi - lo) for lo, hi, f in pairs], rel=1e-12), (key, name)
    assert [r["p0"] for r in K.exact_percentiles(df.where("g = 'empty'"), "a", [0.5]).collect()] == [None]


def test_percentiles_shuffle_only_counts(spark):
    df = spark.range(1, 20_001).select((F.col("id") * 0.5).alias("v"), F.lit("x" * 50).alias("wide"))
    assert list(K.exact_percentiles(df, "v", [0.5, 0.25]).first()) == [5000.25, 2500.375]


# --- alignment -------------------------------------------------------------------------------

GOLD = "sample_id long, source_text string, emotion_label string, reference_narrative string"
PRED = "sample_id long, predicted_narrative string, predicted_emotion_label string"


def test_align_parts(spark):
    gold = spark.createDataFrame([(0, "s", "Joy", "r"), (1, "s", "Fear", "r")], GOLD)
    pred = spark.createDataFrame([(1, "p", "Fear"), (9, "p", "Joy")], PRED)
    parts = A.align(gold, pred)
    assert [r["sample_id"] for r in parts.aligned.collect()] == [1]
    assert [(r["sample_id"], r["status"]) for r in parts.missing.collect()] == [(0, "missing_prediction")]
    assert [(r["sample_id"], r["status"]) for r in parts.extra.collect()] == [(9, "extra_prediction")]
    with pytest.raises(A.ValidationError):
        A.align(gold, pred.union(pred))


def test_pair_runs_checks(spark):
    a = spark.createDataFrame([(1, "r"), (2, "r")], "sample_id long, reference_narrative string")
    assert A.pair_runs(a, a).count() == 2
    with pytest.raises(A.ValidationError):
        A.pair_runs(a, a.where("sample_id = 1"))
    with pytest.raises(A.ValidationError):
        A.pair_runs(a, a.withColumn("reference_narrative", F.lit("other")))


def test_pivot_conditions_needs_every_cell(spark):
    rows = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.7), (2, "x", 0.1)], "sample_id long, condition string, value double")
    with pytest.raises(A.ValidationError):
        A.pivot_conditions(rows, ["x", "y"])
    assert A.pivot_conditions(rows.where("sample_id = 1"), ["x", "y"]).first()["y"] == 0.7


# --- label metrics ---------------------------------------------------------------------------

def cells(spark, pairs):
    return L.cell_counts(spark.createDataFrame(pairs, "emotion_label string, predicted_emotion_label string"))


def test_macro_f1_policies(spark):
    table = cells(spark, [("Joy", "Joy"), ("Joy", ""), ("Fear", "Fear"), ("Fear", "Joy")])
    # Joy: tp 1, support 2, predicted 2 -> 0.5; Fear: tp 1, support 2, predicted 1 -> 2/3; "" -> 0
    assert L.macro_f1(table).first()[0] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert L.macro_f1(table, "fixed").first()[0] == pytest.approx((0.5 + 2 / 3) / 7)
    with pytest.raises(ValueError):
        L.macro_f1(table, "other")


def test_complete_rows_rejects_unknown(spark):
    df = spark.createDataFrame([("joy", "FEAR"), ("Joy", None)], "emotion_label string, predicted_emotion_label string")
    assert [tuple(r) for r in L.complete_rows(df).collect()] == [("Joy", "Fear")]
    with pytest.raises(A.ValidationError):
        L.complete_rows(df.union(spark.createDataFrame([("Joy", "Glad")], df.schema)))


def test_confusion_grid_zero_fill(spark):
    grid = {(r["gold"], r["pred"]): r["n"] for r in L.confusion_grid(cells(spark, [("a", "b"), ("a", "b")])).collect()}
    assert grid == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 0, ("b", "b"): 0}


# --- BLEU and ROUGE --------------------------------------------------------------------------

def texts(spark, *pairs):
    rows = [(i, h, r) for i, (h, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "sample_id long, predicted_narrative string, reference_narrative string")


def test_bleu_hand_cases(spark):
    df = texts(spark, ("the cat sat on the mat", "the cat sat on the mat"), ("x y z w", "a b c d"), ("the cat", "the cat sat on the mat"), ("", "a b"))
    scores = {r["sample_id"]: r["bleu_sentence"] for r in O.sentence_bleu(O.bleu_statistics(df)).collect()}
    assert scores[0] == pytest.approx(100.0)
    assert scores[1] == 0.0 and scores[3] == 0.0
    assert scores[2] == pytest.approx(100 * math.exp(1 - 6 / 2))  # two orders reached, both perfect


def test_bleu_smoothing_and_clipping(spark):
    # unigrams: "the" clipped to 1 of 3; no higher order matches: 100/(2*2), 100/(4*1), nothing of order 4
    df = texts(spark, ("the the the", "the cat sits here"))
    stats = O.bleu_statistics(df).first().asDict()
    assert (stats["match_1"], stats["total_1"], stats["total_4"]) == (1, 3, 0)
    logs = [math.log(100 / 3), math.log(100 / 4), math.log(100 / 4)]
    assert O.sentence_bleu(O.bleu_statistics(df)).first()["bleu_sentence"] == pytest.approx(math.exp(1 - 4 / 3) * math.exp(sum(logs) / 3))
    assert O.corpus_bleu(O.bleu_statistics(df)).first()[0] == 0.0


def test_rouge_hand_cases(spark):
    df = texts(spark, ("the cat was found under the bed", "the cat was under the bed"), ("", "a"))
    n = {r["sample_id"]: r for r in O.rouge_n(df, stemmer=False).collect()}
    assert n[0]["rouge1_recall"] == pytest.approx(1.0) and n[0]["rouge1_precision"] == pytest.approx(6 / 7)
    assert n[0]["rouge2_recall"] == pytest.approx(4 / 5) and n[1]["rouge1_fmeasure"] == 0.0
    lcs = {r["sample_id"]: r for r in O.rouge_l(df, stemmer=False).collect()}
    assert lcs[0]["rougeL_precision"] == pytest.approx(6 / 7) and lcs[1]["rougeL_fmeasure"] == 0.0
    stemmed = O.rouge_n(texts(spark, ("running cats", "run cat")), orders=(1,)).first()
    assert stemmed["rouge1_fmeasure"] == pytest.approx(1.0)


def test_overlap_metrics_table(spark):
    per_sample, summary = O.overlap_metrics(texts(spark, ("a b c d e", "a b c d e")), stemmer=False)
    assert {r["metric"]: round(r["value"], 6) for r in summary.collect()} == {
        "bleu_corpus": 100.0, "bleu_sentence_mean": 100.0, "rouge1_mean": 1.0, "rouge2_mean": 1.0, "rougeL_mean": 1.0}
    assert per_sample.count() == 1


# --- parsing ---------------------------------------------------------------------------------

@pytest.mark.parametrize("raw, error", [
    ('{"predicted_narrative":"A party is blamed.","predicted_emotion_label":"Anger"}', ""),
    ('{"predicted_narrative":"cut","predicted_emotion_label":"Neutral"', "invalid_json"),
    ('{"predicted_narrative":"n","predicted_emotion_label":"Neutral","more":1}', "unexpected_keys"),
    ('{"predicted_narrative":"n"}', "unexpected_keys"),
    ('{"predicted_narrative":"n","predicted_emotion_label":"Annoyance"}', "invalid_emotion_label"),
    ('{"predicted_narrative":"  ","predicted_emotion_label":"Neutral"}', "predicted_narrative_is_empty"),
    ('{"predicted_narrative":42,"predicted_emotion_label":"Neutral"}', "predicted_narrative_is_not_a_string"),
    ('{"predicted_narrative":"n","predicted_emotion_label":null}', "predicted_emotion_label_is_not_a_string"),
    ("[1]", "output_is_not_a_json_object"), ("null", "output_is_not_a_json_object"), (None, "invalid_json"), ("", "invalid_json"),
    ('{"predicted_narrative":"a","predicted_narrative":"b","predicted_emotion_label":"Joy"}', "invalid_json")])
def test_strict_parse(spark, raw, error):
    row = P.parse_strict(spark.createDataFrame([(raw,)], "raw_generation string")).first()
    assert row["parse_error"] == error and row["parse_success"] == (error == "")


@pytest.mark.parametrize("raw, narrative, label", [
    ('text {"predicted_narrative": " a  b ", "predicted_emotion_label": "Joy"} tail', "a b", "Joy"),
    ("predicted_narrative: it went\npredicted_emotion_label = 'Fear'", "it went", "Fear"),
    ('{"predicted_narrative": "cut off", "predicted_emotion_label": "Joy"', "cut off", "Joy"), ("nothing", "", "")])
def test_lenient_parse(spark, raw, narrative, label):
    row = P.parse_lenient(spark.createDataFrame([(raw,)], "raw_generation string")).first()
    assert (row["predicted_narrative"], row["predicted_emotion_label"]) == (narrative, label)


@pytest.mark.parametrize("form, raw, narrative, label", [
    ("joint", "Emotion: Joy\nNarrative: x y \n", "x y", "Joy"), ("joint", "Emotion: Joy\nNarrative: x\ny", "", ""),
    ("marker", "Marker: X\nNarrative: z", "z", ""), ("loose", "Emotion: anger!\nNarrative: a\nb", "a\nb", "Anger"),
    ("loose", "Emotion: odd\nrest", "rest", ""), ("label", "Fear\nmore", "", "Fear"), ("label", "afraid", "", "")])
def test_two_line_parse(spark, form, raw, narrative, label):
    row = P.parse_two_line(spark.createDataFrame([(raw,)], "raw_generation string"), form=form).first()
    assert (row["predicted_narrative"], row["predicted_emotion_label"]) == (narrative, label)


# --- preparation -----------------------------------------------------------------------------

def test_keep_first_and_split(spark):
    df = spark.createDataFrame([(i, f"Text {i // 2 if i % 2 else i // 2}", "Joy" if i < 40 else "Fear") for i in range(101)], "id long, text string, label string")
    first = prep.keep_first(df, "text", "id")
    assert sorted(r["id"] for r in first.collect()) == list(range(0, 101, 2))
    split = prep.stratified_split(first, "label", "id", 0.05).collect()
    counts = {(r["label"], r["split"]): 0 for r in split}
    for r in split:
        counts[r["label"], r["split"]] += 1
    assert counts == {("Joy", "validation"): 1, ("Joy", "train"): 19, ("Fear", "validation"): 2, ("Fear", "train"): 29}
    both = prep.deduplicated_split(df, "text", "label", "id", 0.05)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, split))
    assert prep.stratified_split(first.limit(1), "label", "id").first()["split"] == "validation"


def test_split_quota_rounds_half_to_even(spark):
    df = spark.range(50).select("id", F.lit("x").alias("label"))
    assert prep.stratified_split(df, "label", "id", 0.05).where("split = 'validation'").count() == 2


def test_forced_wrong_labels(spark):
    labels = ["Anger"] * 300 + ["Joy"] * 200 + ["Fear"] * 90 + ["Sadness"] * 15
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    out = prep.forced_wrong_labels(df, "label", "id", 3, candidates=16).toPandas()
    assert (out["label"] != out["assigned"]).all()
    assert out["assigned"].value_counts().to_dict() == out["label"].value_counts().to_dict()
    with pytest.raises(A.ValidationError):
        prep.plan_derangement({"a": 6, "b": 5}, 1)
    assert prep.plan_derangement({"a": 2, "b": 2}, 1) == {("a", "b"): 2, ("b", "a"): 2}


def test_permutation_keeps_marginals(spark):
    df = spark.range(500).select("id", F.concat(F.lit("l"), F.col("id") % 4).alias("label"))
    out = prep.permute_labels(df, "label", "id").toPandas()
    assert sorted(out["permuted"]) == sorted(out["label"]) and (out["permuted"] != out["label"]).any()


def test_mutual_information_limits(spark):
    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("l"), (F.floor(F.col("id") / 4) % 5).cast("string").alias("r"))
    assert prep.mutual_information(df, "l", "r").first()["information"] == pytest.approx(0.0, abs=1e-12)
    same = prep.mutual_information(df.withColumn("r", F.col("l")), "l", "r").first()
    assert same["information"] == pytest.approx(math.log(4)) and same["normalized"] == pytest.approx(1.0)


def test_unknown_label_and_duplicate_narrative_fail(spark):
    with pytest.raises(A.ValidationError):
        prep.required_rows(spark.createDataFrame([("t", "Glee")], "text string, label string"), "text", "label")
    rows = prep.alpaca_rows(spark.createDataFrame([("A b", "x"), ("a  B", "y")], "text string, o string"), "s", "i", "text", "o")
    with pytest.raises(A.ValidationError):
        prep.pair_tasks(rows, rows)


def test_overlap_audit_ignores_case_and_blank(spark):
    rows = [("train", "Same  text", "n1"), ("stage1", "same TEXT", ""), ("manual", "other", "N1"), ("validation", "v", "")]
    audit = {(r["kind"], r["pair"]): r["shared"] for r in U.overlap_audit(
        spark.createDataFrame(rows, "split string, source_text string, reference_narrative string")).collect()}
    assert audit["source", "train_vs_stage1"] == 1 and audit["narrative", "train_vs_manual"] == 1
    assert audit["narrative", "validation_vs_stage1"] == 0


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    b = spark.createDataFrame([(2, "x"), (1, "y")], "id long, t string")
    free = lambda d: d.agg(U.order_free_print(F.col("t"))).first()[0]
    ordered = lambda d: d.agg(U.ordered_print(F.col("t"), F.col("id"))).first()[0]
    assert free(a) == free(b) and ordered(a) != ordered(b)


# --- statistics ------------------------------------------------------------------------------

@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_sign_flip_share_equals_enumeration(k):
    rng = np.random.default_rng(k)
    for values in (rng.normal(size=k) + 0.3, rng.integers(-3, 4, k) / 100, np.full(k, 0.1), np.zeros(k)):
        signs = np.array(list(itertools.product([-1, 1], repeat=k)))
        sums = np.abs((signs * values).sum(axis=1))
        assert N.kernels.sign_flip_share(values) == np.mean(sums >= abs(values.sum()) - 1e-12)


@pytest.mark.parametrize("k", [24, 36, 40])
def test_sign_flip_of_many_seeds(spark, k):
    df = spark.createDataFrame([([1.0] * k,), ([float(1 << i) for i in range(k)],)], "v array<double>")
    start = time.perf_counter()
    got = [r[0] for r in df.select(S.sign_flip_p(F.col("v"))).collect()]
    assert got == [2 / 2 ** k, 2 / 2 ** k] and time.perf_counter() - start < 20


def test_sign_flip_and_paired_tests(spark):
    rows = [("d", "rougeL_mean", s, 0.5 + 0.1, 0.5, 0.1) for s in (1, 2, 3)] + [("d", "zero", s, 1.0, 1.0, 0.0) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "dataset string, metric string, seed int, treatment double, control double, advantage double")
    out = {r["metric"]: r for r in S.paired_tests(df).collect()}
    assert out["rougeL_mean"]["exact_sign_flip_p"] == pytest.approx(0.25)
    assert out["zero"]["exact_sign_flip_p"] == 1.0 and out["zero"]["cohen_dz"] is None and out["zero"]["paired_t_p"] is None


def test_holm_ties_and_cap(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.01), ("f", "c", 0.9)], "family string, name string, p double")
    out = {r["name"]: r["p_holm"] for r in S.holm(df, ["family"], "p", "name").collect()}
    assert out == {"a": pytest.approx(0.03), "b": pytest.approx(0.03), "c": pytest.approx(0.9)}


@pytest.mark.parametrize("pairs, p", [([("x", "x", "x")] * 3, 1.0), ([("x", "x", "y")] * 5, 2 * 0.5**5), ([("x", "x", "y"), ("x", "y", "x")], 1.0)])
def test_mcnemar(spark, pairs, p):
    assert S.mcnemar(spark.createDataFrame(pairs, "gold string, pred_a string, pred_b string")).first()["p_value"] == pytest.approx(p)


def test_best_setting_first_wins(spark):
    rows = [("d", "rougeL_mean", "0.3", 0.5), ("d", "rougeL_mean", "0.8", 0.5), ("d", "normalized_dtw_distance_mean", "0.3", 0.2), ("d", "normalized_dtw_distance_mean", "0.8", 0.1)]
    df = spark.createDataFrame(rows, "dataset string, metric string, condition string, value double")
    best = {r["metric"]: r["best_setting"] for r in S.best_setting(df, {"0.3": 0, "0.8": 1}).collect()}
    assert best == {"rougeL_mean": "0.3", "normalized_dtw_distance_mean": "0.8"}


def test_seed_metrics_guard(spark):
    runs = spark.createDataFrame([("d", "c", 1, 0.5, 2)], "dataset string, condition string, seed int, m double, num_missing_prediction_rows int")
    with pytest.raises(A.ValidationError):
        S.seed_metrics(runs, ["m"])


# --- runs ------------------------------------------------------------------------------------

def history(spark, losses):
    return spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(losses)], "run string, step long, eval_loss double")


@pytest.mark.parametrize("losses, reason", [
    ([1.0, 0.9, 0.8], None), ([1.0, 1.1], "immediate_relative_degradation_threshold"), ([1.0, 1.05, 1.02], "validation_patience_exhausted"),
    ([1.0, 1.05], None), ([1.0, 1.0, 1.0], "validation_patience_exhausted"), ([1.0], None)])
def test_early_stop(spark, losses, reason):
    assert R.early_stop(history(spark, losses)).first()["reason"] == reason


def test_summary_precedence_and_aliases(spark):
    a = spark.createDataFrame([("accuracy", 0.1), ("x", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("accuracy", 0.2)], "metric string, value double")
    out = {r["metric"]: r["value"] for r in R.build_summary([a, None, b]).collect()}
    assert out == {"accuracy": 0.2, "x": 1.0, "emotion_accuracy": 0.2}


def test_training_join_guard(spark):
    manifest = spark.createDataFrame([("m1",), ("m2",)], "model_path string")
    results = spark.createDataFrame([("m1", 3.0, 1959)], "model_path string, epoch double, global_step long")
    with pytest.raises(A.ValidationError):
        R.join_training(manifest, results, 2.99, 1959)


# --- vectors and semantics -------------------------------------------------------------------

def vector_table(spark, matrix, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vec array<double>")


def test_top_k_block_path_equals_broadcast_path(spark):
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(40, 6)), rng.normal(size=(55, 6))
    right[7] = right[3]
    left[0] = 0
    a, b = vector_table(spark, left), vector_table(spark, right, 100)
    rows = lambda d: sorted((r["left_id"], r["rank"], r["right_id"], round(r["similarity"], 9)) for r in d.collect())
    small = rows(N.cosine_top_k(a, b, 3))
    assert small == rows(N.cosine_top_k(a, b, 3, broadcast_bytes=0, block_bytes=16 * 56))
    assert N.cosine_top_k(a, b.limit(0), 3).count() == 0
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = unit(left) @ unit(right).T
    expected = [(i, k + 1, 100 + j) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(55), -np.round(scores[i], 12)))[:3])]
    assert [r[:3] for r in small] == expected


@pytest.mark.parametrize("k", [1, 4, 200])
def test_pruned_top_k_gives_the_same_rows(spark, k):
    """Separated groups, copies across a third of the right side, zero vectors on both sides."""
    rng = np.random.default_rng(8)
    groups = rng.normal(size=(12, 16))
    near = lambda n: groups[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) / 12
    left, right = near(120), near(300)
    right[:100], left[0], right[120:123] = right[0], 0, 0
    a, b = vector_table(spark, left), vector_table(spark, right, 1000)
    rows = lambda d: sorted((r["left_id"], r["rank"], r["right_id"], round(r["similarity"], 9)) for r in d.collect())
    report = {}
    pruned = rows(N.cosine_top_k(a, b, k, broadcast_bytes=0, block_bytes=10 * 17 * 8, report=report))
    assert pruned == rows(N.cosine_top_k(a, b, k)) and len(pruned) == 120 * min(k, 300)
    assert report["pairs"] == 120 * report["cells"] and report["cells"] >= 12
    assert k == 200 or report["visited"] < 0.3 * report["pairs"]    # zero vectors have to visit all cells


def test_cells_bound_their_rows():
    rng = np.random.default_rng(2)
    unit = N.kernels.unit_rows(np.vstack([rng.normal(size=(500, 6)), np.zeros((2, 6))]))
    cells = N.AngularCells(N._farthest_first(unit[:60], 15))
    cell, cosine = cells.place(unit)
    assert (cell[-2:] == 15).all()
    cells.measured((c, int((cell == c).sum()), cosine[cell == c].min()) for c in np.unique(cell))
    upper = cells.upper(unit)
    for c in np.unique(cell):
        assert (upper[:, c] >= (unit @ unit[cell == c].T).max(axis=1)).all()


def long_dtw_brute(x, y):
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    cost = np.clip(1 - x @ y.T, 0, 2)
    n, m = cost.shape
    c, s = np.full((n + 1, m + 1), np.inf), np.zeros((n + 1, m + 1), int)
    c[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best, length = min(((c[i - 1, j], s[i - 1, j]), (c[i, j - 1], s[i, j - 1]), (c[i - 1, j - 1], s[i - 1, j - 1])), key=lambda t: t[0])
            c[i, j], s[i, j] = best + cost[i - 1, j - 1], length + 1
    return c[n, m], s[n, m]


@pytest.mark.parametrize("block", [4, 7, 50])
def test_long_alignment_matches_brute_force(spark, block):
    rng = np.random.default_rng(9)
    shapes = {"p": (17, 9), "q": (5, 12)}
    left, right, expected = [], [], {}
    for pair, (n, m) in shapes.items():
        x, y = rng.normal(size=(n, 4)), rng.normal(size=(m, 4))
        left += [(pair, i, r.tolist()) for i, r in enumerate(x)]
        right += [(pair, i, r.tolist()) for i, r in enumerate(y)]
        expected[pair] = (*long_dtw_brute(x, y), n + m)
    schema = "pair string, pos long, vec array<double>"
    for r in N.align_sequences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), block=block).collect():
        raw, length, total = expected[r["pair"]]
        assert r["dtw_distance"] == pytest.approx(raw) and r["dtw_path_length"] == length
        assert r["normalized_dtw_distance"] == pytest.approx(raw / total)
        assert r["path_normalized_dtw_distance"] == pytest.approx(raw / length)


def test_sentence_dtw_and_greedy_match_edges(spark):
    df = texts(spark, ("One thing. Two things.", "One thing. Two things."), ("", "Words here."), ("other words", "Words here. And more."))
    dtw = {r["sample_id"]: r for r in M.sentence_dtw(df).collect()}
    assert dtw[0]["dtw_distance"] == pytest.approx(0.0, abs=1e-12) and dtw[1]["dtw_distance"] is None
    assert dtw[2]["normalized_dtw_distance"] == pytest.approx(dtw[2]["dtw_distance"] / 3)
    greedy = {r["sample_id"]: r for r in M.greedy_match(df).collect()}
    assert greedy[0]["bertscore_f1"] == pytest.approx(1.0) and greedy[1]["bertscore_f1"] is None
    summary = {r["metric"]: r["value"] for r in M.semantic_summary(M.sentence_dtw(df).join(M.greedy_match(df), "sample_id")).collect()}
    assert summary["bertscore_f1_mean"] == pytest.approx((greedy[0]["bertscore_f1"] + greedy[2]["bertscore_f1"]) / 2)


def test_cluster_noise_and_order(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, .05, (60, 3)) + [5, 0, 0], rng.normal(0, .05, (40, 3)) + [0, 5, 0], rng.normal(0, .05, (4, 3)) + [0, 0, 50]])
    out = T.cluster_topics(vector_table(spark, points), k=3, components=None, min_size=10).toPandas()
    assert out["topic_id"].value_counts().to_dict() == {0: 60, 1: 40, -1: 4}


# --- corpus, judge, generation ---------------------------------------------------------------

def test_histogram_right_edge(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.99,), (1.5,)], "v double")
    bins = {r["bin"]: r["n"] for r in C.histogram(df, "v", 0, 1, 20).collect()}
    assert bins[1] == 1 and bins[20] == 2 and sum(bins.values()) == 3 and len(bins) == 20


def test_narrative_ratio(spark):
    df = spark.createDataFrame([("I walked and we talked, then I go.",), ("",)], "text string")
    row = C.narrative_ratios(df).collect()
    assert len(row) == 1 and row[0]["past_verb_ratio"] == pytest.approx(2 / 3) and row[0]["first_person_ratio"] == pytest.approx(3 / 10)


def test_word_count_column_rules(spark):
    df = spark.createDataFrame([(1, "a", "100"), (2, "b", "bad"), (3, "c", "81.9")], "id long, text string, word_count string")
    assert [r["id"] for r in C.long_documents(df).collect()] == [1, 3]
    assert [r["id"] for r in C.sequential_sample(df, "id", 1).collect()] == [1]


def test_cache_key_depends_on_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string")
    keys = [r[0] for r in df.select(J.cache_key(F.col("id"), "m", "v", F.col("t"))).collect()]
    assert keys[0] != keys[1]


def test_failed_request_keeps_row_or_raises(spark):
    def make():
        def call(prompt):
            raise RuntimeError("down")
        return call
    df = spark.createDataFrame([(1, "p")], "sample_id long, prompt string")
    row = G.generate_predictions(df, "prompt", make, "m", "r").first()
    assert row["request_error"] == "RuntimeError: down" and row["parse_error"] == "" and not row["parse_success"]
    with pytest.raises(Exception, match="request failed"):
        G.score_rows(df, "prompt", make, "x int").collect()
    assert G.score_rows(df, "prompt", make, "x int", check=False).first()["x"] is None


def test_token_batches_match_sequential_greedy(spark):
    sizes = [int(x) for x in np.random.default_rng(2).integers(1, 60, 200)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "shard int, id long, tokens int")
    got = {r["id"]: r["batch"] for r in G.token_batches(df, "shard", "id", "tokens", 8, 150).collect()}
    batch, current = 0, []
    for i, size in enumerate(sizes):
        if current and (len(current) >= 8 or max([*current, size]) * (len(current) + 1) > 150):
            batch, current = batch + 1, []
        current.append(size)
        assert got[i] == batch
    cut = df.withColumn("shard", F.floor(F.col("id") / 50))
    firsts = G.token_batches(cut, "shard", "id", "tokens", 8, 150).groupBy("shard").agg(F.min("batch"), F.count("*")).collect()
    assert sorted(map(tuple, firsts)) == [(k, 0, 50) for k in range(4)]


@pytest.mark.parametrize("rows", [0, 1, 7, 1000, 5000])
def test_first_by_ordinal(spark, rows):
    far = spark.createDataFrame([(1 << 60,), (None,)], "ordinal long")  # one outlier must not put all rows into one bucket
    df = spark.range(3000).select((F.col("id") * F.col("id")).alias("ordinal")).repartition(8).union(far)
    got = K.first_by_ordinal(df, "ordinal", rows, small=16)
    assert sorted(r[0] for r in got.collect()) == ([i * i for i in range(3000)] + [1 << 60])[:rows]
    assert rows < 1000 or got.rdd.getNumPartitions() > 1
