"""Word bigram models against counting with dictionaries."""
import numpy as np
import pytest

from narralytics.llm import word_lm
from narralytics.llm.common import table
from narralytics.llm.queries import QUERIES, SQL
from tests.llm.helpers import awkward, by_id, count, documents, empty, prose
from tests.llm.test_findings import plain_losses, plain_words
from tests.oracle import connect


def plain_scores(background, target):
    vocabulary = {w for t in background + target for w in plain_words(t)}
    models = [plain_losses(t, vocabulary) for t in (target, background)]
    for text in background:
        s = plain_words(text)
        yield len(s), *[sum(m(v, w) for v, w in zip(["<s>", *s], s)) / len(s) for m in models]


@pytest.mark.parametrize("chunk, shard", [(1, 1 << 21), (40, 3), (1 << 20, 50)])
def test_scores_equal_plain_models_for_any_packing(spark, chunk, shard):
    hot = "in the end, in the end"
    background = [prose(i, 30) for i in range(20)] + [hot] * 15 + [None, "", "été 12!", "日本 12 :)", "word " * 3000 + "last"]
    target = ["winter music, winter music.", "in the end", "silver paper 日", ""]
    got = by_id(word_lm.cross_entropy_difference(documents(spark, background).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), chunk, shard))
    assert len(got) == len(background)
    for i, (n, t, b) in enumerate(plain_scores(background, target)):
        assert got[i].n_tokens == n
        assert (got[i].target_loss, got[i].background_loss, got[i].difference) == pytest.approx((t, b, t - b), abs=1e-9)


def test_query_equals_its_sql(spark, sf_dir):
    want = connect(sf_dir).execute(SQL["op9_lm_difference"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op9_lm_difference"](spark, sf_dir).select(names).collect())) == sorted(want.fetchall())
    assert count(QUERIES["op9_lm_difference"](spark, sf_dir)) == count(table(spark, sf_dir, "documents"))


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 2 ** 64 - 1), (5000, 3), (5000, 300), (5000, 2 ** 63)])
def test_packed_numbers_come_back(n, top):
    rng = np.random.default_rng(n + 1)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
    assert np.array_equal(word_lm.unpack(word_lm.pack(values), n), values)
    values.sort()
    assert np.array_equal(word_lm.unpack_sorted(word_lm.pack_sorted(values), n), values)


def test_awkward_rows(spark):
    got = word_lm.cross_entropy_difference(awkward(spark), empty(spark).select("text")).collect()
    assert len(got) == 8 and all(np.isfinite(r.difference) for r in got)
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "4", "5", "6", "None"]
    assert count(word_lm.cross_entropy_difference(empty(spark), awkward(spark))) == 0
    assert count(word_lm.cross_entropy_difference(empty(spark), empty(spark))) == 0
