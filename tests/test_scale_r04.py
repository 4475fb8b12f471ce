"""Steps whose cost once grew faster than their input, or that were done more often than needed (round 4)."""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from narralytics.functions import kernels, plugins
from narralytics.functions import text as X
from narralytics.functions import words as W
from narralytics.operators import overlap_metrics as O
from narralytics.operators import semantic as M
from narralytics.plans import evaluation

ODD = [
    ("One thing. Two things! A third?", "One thing. A  third?"), ("", "Words here."), (None, None), ("Words.", None), ("  ", "\t"),
    ("a.b 3.5 1,000 &quot;x&quot; <skipped>y- z", "a.b 3.5 &amp; &lt;x&gt; y- z..."), ("Élan vital ΣΑΣ. Naïve ones\nhere-\nthere. ", "élan vital σας. naïve ones"),
    ("running ponies relational. " * 40, "ran pony related. running " * 35), ("! ? . ...", "! . ?"), ("same words.", "same words."),
    *[(f"row {i} has {'many ' * (i % 9)}words. It ends here{'.' * (i % 2)} Or{i}", f"row {i} has words. Or{i % 3} not") for i in range(150)],
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(ODD)], "sample_id long, reference_narrative string, predicted_narrative string")


class Plain:
    """An encoder of whole texts that knows nothing of words or runs."""

    def encode(self, texts):
        return np.array([[len(t), t.count("e") + 1, sum(map(ord, t)) % 97] for t in texts], dtype=float).reshape(-1, 3)


def _close(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[0] == b[0] and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a[1:], b[1:])), (a, b)


def test_one_pass_scores_texts_like_the_operators_alone(odd):
    counted = M.text_scores(odd)
    rows = lambda df: sorted(map(tuple, df.collect()))
    _close(rows(M.sentence_dtw(counted, counted=True)), rows(M.sentence_dtw(odd)))
    _close(rows(M.greedy_match(counted, counted=True)), rows(M.greedy_match(odd)))
    for with_counts, alone in zip(O.overlap_metrics(counted, counted=True), O.overlap_metrics(odd)):
        _close(rows(with_counts), rows(alone))


def test_scorers_take_any_encoder(odd):
    scorers = [M.sentence_scorer(Plain), M.token_scorer(Plain)]
    counted = O.overlap_counts(odd, "sample_id", "predicted_narrative", "reference_narrative", {}, scorers)
    _close(sorted(map(tuple, M.sentence_dtw(counted, counted=True).collect())), sorted(map(tuple, M.sentence_dtw(odd, make_encoder=Plain).collect())))
    _close(sorted(map(tuple, M.greedy_match(counted, counted=True).collect())), sorted(map(tuple, M.greedy_match(odd, make_encoder=Plain).collect())))


def test_an_evaluation_reads_its_texts_in_one_pass(odd, monkeypatch):
    passes = []
    real = O.overlap_counts
    counting = lambda *a, **k: passes.append(1) or real(*a, **k)
    monkeypatch.setattr(O, "overlap_counts", counting)
    monkeypatch.setattr(M, "overlap_counts", counting, raising=False)
    label = F.element_at(F.array(F.lit("Joy"), F.lit("Fear")), (F.col("sample_id") % 2 + 1).cast("int"))
    gold = odd.select("sample_id", F.lit("s").alias("source_text"), label.alias("emotion_label"), "reference_narrative")
    pred = odd.select("sample_id", "predicted_narrative", F.lit("Joy").alias("predicted_emotion_label"))
    result = evaluation.evaluate(gold, pred)
    for table in (result.summary, result.per_sample):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "ArrowEvalPython" not in plan     # what sinks read has been scored already
    assert len(passes) == 1
    summary = {r["metric"]: r["value"] for r in result.summary.collect()}
    scored = M.sentence_dtw(odd).join(M.greedy_match(odd), "sample_id")
    for table in (O.overlap_metrics(odd)[1], M.semantic_summary(scored)):
        for r in table.collect():
            assert math.isclose(summary[r["metric"]], r["value"], rel_tol=1e-9)
    assert result.per_sample.count() == len(ODD)


def test_sentence_runs_are_the_sentences(spark, odd):
    texts = [t for pair in ODD for t in pair]
    words = W.Words(pa.array(texts))
    at, sentence, text = W.sentence_runs(words)
    names, found = words.distinct.to_pylist(), [[] for _ in texts]
    for s, t in enumerate(text.tolist()):
        found[t].append(" ".join(names[w] for w in at[sentence == s]))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.sentences(F.col("t")).alias("s"))
    assert found == [r["s"] for r in sorted(df.collect())]


def test_subsequences_of_many_rows_equal_one_by_one():
    rng = np.random.default_rng(5)
    for high, tokens in ((1, 3), (9, 4), (70, 12), (300, 40)):
        sizes = rng.integers(0, high, 2 * 50)
        lists = np.repeat(np.arange(len(sizes)), sizes)
        codes = rng.integers(0, tokens, len(lists))
        texts = [codes[lists == i].tolist() for i in range(len(sizes))]
        expected = [kernels.lcs_length(h, r) for h, r in zip(texts[:50], texts[50:])]
        assert all(kernels.lcs_lengths(codes, lists, 50, cells).tolist() == expected for cells in (4_000_000, 60))


def test_ngrams_of_any_order_are_counted_like_sets_of_tuples():
    rng = np.random.default_rng(6)
    for trial in range(60):
        rows, systems = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        sizes = rng.integers(0, 11, (systems + 1) * rows) * rng.integers(0, 2, (systems + 1) * rows)
        lists = np.repeat(np.arange(len(sizes)), sizes)
        codes = rng.integers(0, 4, len(lists)) * (1 << 29 if trial % 5 == 0 else 1)
        texts = [codes[lists == i].tolist() for i in range(len(sizes))]
        for orders in ((1, 2, 3, 4), (1,), (2, 5), (3,), (5, 6, 7)):
            found = kernels.clipped_counts(codes, lists, rows, orders, systems)
            for n in orders:
                grams = [Counter(zip(*[t[i:] for i in range(n)])) for t in texts]
                for s in range(systems):
                    for r in range(rows):
                        h, ref = grams[s * rows + r], grams[systems * rows + r]
                        assert found[n][3 * s:3 * s + 3, r].tolist() == [(h & ref).total(), h.total(), ref.total()]


def test_long_grids_are_walked_in_bounded_memory():
    rng = np.random.default_rng(7)
    x, y = (kernels.unit_rows(rng.normal(size=(n, 6))) for n in (300, 260))
    cost = 1.0 - x @ y.T
    totals = np.full((301, 261), np.inf)
    totals[0, 0] = 0.0
    for i in range(300):
        for j in range(260):
            totals[i + 1, j + 1] = cost[i, j] + min(totals[i, j], totals[i, j + 1], totals[i + 1, j])
    assert 300 * 260 > kernels.LONG_GRID
    assert np.allclose([kernels.dtw_cost(cost), *kernels.dtw_costs([(x, y), (y, x), (x[:40], y[:50])])[:2], kernels._dtw_pair(x, y, 1)], totals[-1, -1], rtol=0, atol=1e-10)


def test_tokens_are_hashed_together_as_one_by_one():
    texts = ["a", "bc", "Straße", "😀x", "İx", "the", "the"]
    for some in (texts, ["", "a"], []):
        slots = kernels.KnownSlots(32, 11)
        padded = [f"^{t.lower()}$" for t in some]
        expected = slots.vectors([p[i:i + 3] for i in range(max(1, len(p) - 2))] for p in padded)
        assert (plugins.CharHashingEncoder().encode(some) == expected).all()
