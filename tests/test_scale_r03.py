"""Steps whose cost once grew faster than their input (round 3)."""
from __future__ import annotations

import math
import tempfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from narralytics import catalog
from narralytics.functions import kernels, plugins
from narralytics.functions import text as X
from narralytics.functions import words as W
from narralytics.operators import corpus as C
from narralytics.operators import overlap_metrics as O
from narralytics.operators import prep as P
from narralytics.operators import semantic as M
from narralytics.operators import topics as T
from narralytics.streaming import early_stop


def _brute_terms(rows, min_topics):
    counts = Counter()
    for topic, text in rows:
        words = text.split()
        counts.update((topic, w) for w in words)
        counts.update((topic, f"{a} {b}") for a, b in zip(words, words[1:]))
    topics_of, total = Counter(t for _, t in counts), Counter()
    for (_, term), n in counts.items():
        total[term] += n
    kept = {k: n for k, n in counts.items() if topics_of[k[1]] >= min_topics}
    sizes = Counter()
    for (topic, _), n in kept.items():
        sizes[topic] += n
    average = sum(sizes.values()) / len(sizes)
    return {k: n / sizes[k[0]] * math.log(1 + average / total[k[1]]) for k, n in kept.items()}


def test_only_shared_terms_are_written_and_any_number_of_topics_counts_alike(spark, monkeypatch):
    rows = [(i % 40, f"zebra quartz{i % 40} lemur{i % 3} zebra") for i in range(80)] + [(3, "zebra lemur1"), (None, "zebra zebra")]
    written = []
    real = T.stored
    monkeypatch.setattr(T, "stored", lambda df, name: written.append(real(df, name)) or written[-1])
    for topics in (40, 20):     # more and fewer than WIDE_TOPICS
        some = [r for r in rows if r[0] is None or r[0] < topics]
        df = spark.createDataFrame(some, "topic_id int, text string")
        found = {(r.topic_id, r.term): r.weight for r in T.topic_terms(df, min_topics=5, k=50).collect()}
        expected = {k: v for k, v in _brute_terms(some, 5).items() if k[0] is not None}
        assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k]) for k in found)
        assert written[-1].where("term like '%quartz%'").count() == 0


def test_many_alignments_in_one_walk_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    sizes = [(1, 1), (1, 7), (9, 2), (30, 31), (4, 40), *[(int(a), int(b)) for a, b in rng.integers(1, 25, (60, 2))]]
    pairs = [tuple(kernels.unit_rows(rng.normal(size=(n, 5))) for n in nm) for nm in sizes]
    single = [kernels.dtw_cost(1.0 - x @ y.T) for x, y in pairs]
    for cells in (1, 500, 1_000_000):
        assert np.allclose(kernels.dtw_costs(pairs, cells), single, rtol=0, atol=1e-12)
    assert kernels.dtw_costs([]).size == 0


def test_sentences_of_many_rows_are_encoded_together():
    class Counting(plugins.HashingEncoder):
        calls = 0

        def encode(self, texts):
            Counting.calls += 1
            return super().encode(texts)

    refs = [[f"word{i} here.", "same words."] for i in range(50)] + [[], None]
    found = M._dtw_rows(refs, [[*(r or ["x"])[::-1]] for r in refs], Counting())
    assert Counting.calls == 1 and np.isnan(found[50:]).all() and (found[:50, 0] >= 0).all()


def test_tokens_on_both_sides_need_no_search(monkeypatch):
    searched = []
    real = M._best
    monkeypatch.setattr(M, "_best", lambda own, other, sure: searched.append(int((~sure).sum())) or real(own, other, sure))
    ref = [f"token{i}" for i in range(200)] * 2
    hyp = [t for i, t in enumerate(ref) if i % 7] + ["new"]
    encoder = plugins.CachedEncoder(plugins.CharHashingEncoder())
    precision, recall, _ = M._greedy(hyp, ref, encoder)
    h, r = (kernels.unit_rows(plugins.CharHashingEncoder().encode(x)) for x in (hyp, ref))
    assert math.isclose(precision, (h @ r.T).max(axis=1).mean()) and math.isclose(recall, (r @ h.T).max(axis=1).mean())
    assert searched[0] == 1 and sum(searched) < 30


def test_cached_vectors_outlive_growth_and_limit():
    plain, cached = plugins.HashingEncoder(), plugins.CachedEncoder(plugins.HashingEncoder(), 1500)
    for start in range(0, 4000, 700):
        texts = [f"a{i} b{i % 9}" for i in range(start, start + 900)]
        assert (cached.encode(texts) == plain.encode(texts)).all()


def test_whitespace_and_words_as_before(spark):
    texts = ["", " ", None, "a  b", " a\tb\n", "a b", " x   y", "a \x1c b\x1fc", "one two", "\n\na\r\nb  ", "a\u0085b c", "tab\t\tend\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("t"), F.lit("")), X.WHITESPACE, " "))
    for r in df.select(X.collapse(F.col("t")).alias("c"), plain.alias("p"), X.words(F.col("t")).alias("w"), F.array_remove(F.split(plain, " "), "").alias("q")).collect():
        assert r.c == r.p and r.w == r.q


def test_prompt_tokens_are_those_of_the_whole_prompt(spark):
    texts = [".5 a.b", "a-", "3,5 - x.", "", "...5 ..5", "-5 &quot;x", None, "w " * 9 + ".5", "no - hyphen-", "tail <skipped>"]
    heads = [("sys", "do it."), ("s-", "end-"), ("5.", "x-<skipped>"), (None, "-"), ("sys", None), ("", "7")]
    rows = [(t, "Joy", t, s, i, s, i) for t in texts for s, i in heads]
    df = spark.createDataFrame(rows, "source_text string, emotion_label string, reference_narrative string, label_system string, label_instruction string, narrative_system string, narrative_instruction string")
    sized = P.task_rows(df, 4, 20)
    def plain(text):
        return X.tokens_13a(text)
    other = P.task_rows(df, 4, 20, plain)       # any other tokeniser reads whole prompts
    assert sorted(map(str, sized.collect())) == sorted(map(str, other.collect())) and sized.columns == other.columns


def test_tags_are_computed_once_and_existence_needs_one_leading_character(spark):
    rules = [("mail", r"[a-z0-9.]+@[a-z0-9.]+"), ("eager", r"[ab]++b"), ("number", r"[0-9]{3,}"), ("end", r"x+y")]
    assert [X.existence_pattern(p) for _, p in rules] == [r"[a-z0-9.]@[a-z0-9.]+", r"[ab]++b", r"[0-9]{3,}", r"x+y"]
    df = spark.createDataFrame([("a@b",), ("@b a@",), ("ab",), ("1234 xxy",), ("",), (None,)], "text string")
    tagged = C.tag_documents(df, rules, require_topic=True)
    assert {r.text: r.topics for r in tagged.collect()} == {"a@b": "mail", "1234 xxy": "number,end"}
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("a-z0-9") == 2     # one pattern, named once


def test_only_few_rows_are_python_strings_at_a_time():
    lists = pa.array([["running", "ponies"], None, [], ["cats"]] * 700)
    seen = []
    out = plugins.stemmed(lists.slice(1), lambda t: seen.append(t) or t[:3], rows=500)
    assert out.to_pylist() == [x if x is None else [t[:3] for t in x] for x in lists.slice(1).to_pylist()] and len(seen) < 30
    runs = [len(r) for r, _ in M._slices(lists, lists, 100)]
    assert sum(runs) == len(lists) and max(runs) <= 70 and list(M._slices(lists.slice(0, 0), lists.slice(0, 0))) == []


def test_target_lengths_are_those_of_the_whole_target(spark):
    rows = [(t, lab) for t in (".5 a", "-x", " , b ", "", None, "a-b &amp; 3-4", "...") for lab in ("Joy", "x-", "5.", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    names = ["true", "forced_wrong", "constant_neutral", "marker_control"]
    found = P.target_tokens(df, names, F.col("l"), F.lit("Fear."), F.col("t"))
    whole = F.size(X.tokens_13a(P.target_text(F.col("condition"), F.col("l"), F.lit("Fear."), F.col("t"))))
    assert found.count() == 4 * len(rows) and found.where(F.col("n") != whole).count() == 0 and found.columns == ["t", "l", "condition", "n"]
    counted = found._jdf.queryExecution().optimizedPlan().toString().count("&quot;")
    assert counted == 2     # once for the narrative, once for the heads


def test_a_trigger_reads_and_writes_the_state_of_a_run_once():
    class Value:
        kept, calls = None, 0

        def exists(self):
            return self.kept is not None

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls, self.kept = self.calls + 1, value

    class Handle:
        def __init__(self):
            self.values = {}

        def getValueState(self, name, schema):  # noqa: N802
            return self.values.setdefault(name, Value())

    handle, monitor = Handle(), early_stop.StopMonitor("run", "long", 2, 0.1, False)
    monitor.init(handle)
    first = pd.DataFrame({"step": range(1, 400), "eval_loss": np.linspace(3.0, 2.0, 399)})
    second = pd.DataFrame({"step": [400, 399], "eval_loss": [2.5, 1.9]})    # the last one is a correction
    assert next(monitor.handleInputRows((7,), iter([first]), None)).iloc[0]["best_step"] == 399
    row = next(monitor.handleInputRows((7,), iter([second]), None)).iloc[0]
    assert (row["best_step"], row["best_loss"], row["latest_step"], row["reason"]) == (399, 1.9, 400, "immediate_relative_degradation_threshold")
    assert handle.values["losses"].calls == 4


def test_words_have_the_tokens_of_the_whole_text(spark):
    pieces = ["a", "B7", "7", ".", ",", "-", "-\n", "\n", " ", "  ", "\t", "\x1c", "\u00a0", "'", "!", "$", "&amp;", "&amp;lt;", "&am", "p;", "&quot;", "<skipped>", "\u00e9", "\u0130", "\u212a", "\U0001f600", "_", "/"]
    rng = np.random.default_rng(3)
    texts = ["", ".", "x.,5", "1-2,3.", ",.a .,b", "end-<skipped>\nof", *["".join(rng.choice(pieces, rng.integers(1, 40))) for _ in range(3000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    for cut, column in ((W.make_13a(), X.tokens_13a), (W.make_alnum(), X.tokens_alnum), (W.make_stems(), lambda t: plugins.stem_tokens(X.tokens_alnum(t)))):
        whole = {r["i"]: r["w"] for r in df.select("i", column(F.col("t")).alias("w")).collect()}
        for some in (texts, [t for t in texts if "\n" not in t and "\t" not in t]):      # a call with spaces only, too
            named = {}
            tokens, of = W.numbered_tokens(pa.array(some), cut)
            for i, text in enumerate(some):
                mine, expected = tokens[of == i].tolist(), whole[texts.index(text)]
                assert len(mine) == len(expected) and all(named.setdefault(n, e) == e for n, e in zip(mine, expected)), text
            assert len(set(named.values())) == len(named)


def test_overlap_counts_tokenise_a_word_once(spark):
    calls = []
    tokens, of = W.numbered_tokens(pa.array(["a b. a", None, "b.  a"]), lambda words: calls.extend(words.to_pylist()) or W.cut_13a(words))
    assert tokens.tolist() == [0, 1, 2, 0, 1, 2, 0] and of.tolist() == [0, 0, 0, 0, 2, 2, 2] and sorted(c for c in calls if c) == ["a", "b."]
    texts = spark.createDataFrame([(1, "the cat, the cat", "a cat, the"), (2, None, "x"), (None, "x", "x")], "k long, h string, r string")
    rows = {r["k"]: r for r in O.bleu_statistics(texts, "h", "r", "k").collect()}
    assert rows[1][1:] == (5, 4, 3, 2, 1, 0, 5, 4, 3, 2) and rows[2]["hyp_len"] == 0 and rows[None]["match_1"] == 1


def test_ngrams_are_numbered_alike_whatever_their_keys():
    keys = np.array([7, 0, 7, 1 << 40, 3])
    for bits in (63, 50, 10):
        which, size = kernels.numbered(keys, bits)
        assert which.tolist() == [2, 0, 2, 3, 1] and size == 4
    assert kernels.numbered(np.zeros(0, np.int64))[1] == 0 and kernels.numbered(np.array([1 << 62]))[1] == 1
    codes, lists = np.array([0, 1, 0, 1, 0, 1, 2]), np.array([0, 0, 0, 0, 1, 1, 1])
    found = kernels.clipped_counts(codes, lists, 1, (1, 2, 3))
    assert [found[n].ravel().tolist() for n in (1, 2, 3)] == [[2, 4, 3], [1, 3, 2], [0, 2, 1]]
    two = kernels.clipped_counts(np.concatenate([codes[:4], [2], codes[4:]]), np.array([0, 0, 0, 0, 1, 2, 2, 2]), 1, (1, 2, 3), 2)
    assert [two[n].ravel().tolist() for n in (1, 2, 3)] == [[2, 4, 3, 1, 1, 3], [1, 3, 2, 0, 0, 2], [0, 2, 1, 0, 0, 1]]


def test_systems_counted_together_equal_each_alone(spark):
    rows = [(i, f"the cat{i % 3}, the  dog-{i} 3.5", " ".join(["the", f"cat{i % 3}"] * (i % 4)), None if i == 5 else "the dog. <skipped>") for i in range(300)]
    df = spark.createDataFrame([*rows, rows[0]], "sample_id long, reference_narrative string, x string, y string")
    counts = O.system_counts(df, {"x": "x", "y": "y"})
    for system in "xy":
        assert sorted(map(tuple, O.bleu_statistics(counts[system], counted=True).collect())) == sorted(map(tuple, O.bleu_statistics(df, hyp=system).collect()))
        alone = O.rouge_n(df, hyp=system, orders=(1,), stemmer=False)
        assert sorted(map(tuple, O.rouge_n(counts[system], orders=(1,), stemmer=False, counted=True).collect())) == sorted(map(tuple, alone.collect()))


def test_vectors_are_summed_where_their_document_is(spark):
    rows = [(1, "one two. two three! one two."), (2, "one two."), (None, "four."), (None, "four five."), (3, None), (4, "")]
    encoded = M.encode_sentences(spark.createDataFrame(rows, "k long, text string"), "k", ["text"])
    sums = M.summed_vectors(encoded, "k", 32)
    expected = Counter()
    for key, text in rows:
        for dim, value in enumerate(plugins.HashingEncoder().encode([text or ""])[0]):
            expected[key, dim] += value
    found = {(r["k"], r["dim"]): r["value"] for r in sums.collect()}
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v} and {k for k, _ in found} == {1, 2, None}
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([(i, "one two. three!") for i in range(20)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        query = catalog.load_all()["encoded_sentences"].run(spark, folder)
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning(doc_id" in line and "dim#" in line]     # no sums before the move
        assert query.select("doc_id").distinct().count() == 20
