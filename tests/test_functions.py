import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narralytics.functions import kernels, porter
from narralytics.functions import text as T
from narralytics.functions.labels import label_code, remap_label


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    (None, ""), ("", ""), (" a \n\t b\x1cc ", "a b c"), ("a  b", "a b"), ("x\x85y", "x y")])
def test_collapse(spark, text, expected):
    assert one(spark, T.collapse(F.col("t")), t=text) == expected


def test_match_key_folds_sharp_s_and_case(spark):
    assert one(spark, T.match_key(F.col("t")), t="Straße  X") == one(spark, T.match_key(F.col("t")), t="STRASSE x")


@pytest.mark.parametrize("text, expected", [
    ("A. B! C?", ["A.", "B!", "C?"]), ("no end", ["no end"]), ("Dr. Who came.", ["Dr.", "Who came."]), ("  ", []), ("a.b", ["a.b"])])
def test_sentences(spark, text, expected):
    assert one(spark, T.sentences(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("abcdefghij", "abcdefghij"), ("abcdefghijk", "abcdefg..."), ("abcdef hijk", "abcdef...")])
def test_truncate(spark, text, expected):
    assert one(spark, T.truncate(F.col("t"), 10), t=text) == expected


def test_urls_markup_and_markers(spark):
    assert one(spark, T.collapse_without_urls(F.col("t")), t="see http://a.b/c?d now") == "see now"
    assert one(spark, T.clean_markup(F.col("t")), t="> quote\n**bold** &amp; &lt;b&gt;&#x200B;") == "quote\nbold & <b>"
    assert one(spark, T.usable_comment(F.col("t")), t=" [deleted] ") is None
    assert one(spark, T.usable_comment(F.col("t"), 4), t="  abcdef ") == "abcd"


@pytest.mark.parametrize("n, expected", [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_ngrams(spark, n, expected):
    assert one(spark, T.ngrams(F.col("t"), n), t=["a", "b", "c"]) == expected


@pytest.mark.parametrize("text, expected", [
    ("Hello, world!", ["Hello", ",", "world", "!"]), ("1,000.5 and 3-4", ["1,000.5", "and", "3", "-", "4"]),
    ("it's $5 &quot;x&quot;", ["it's", "$", "5", '"', "x", '"']), ("", [])])
def test_tokens_13a(spark, text, expected):
    assert one(spark, T.tokens_13a(F.col("t")), t=text) == expected


def test_render_never_rescans_values(spark):
    assert one(spark, T.render("<{{ a }}|{{ b }}>", {"a": F.col("a"), "b": F.col("b")}), a="{{ b }}", b="2") == "<{{ b }}|2>"


def test_last_match_and_labels(spark):
    assert one(spark, T.last_match(F.col("t"), r"(\d+)/3915"), t="1/3915 x 27/3915") == "27"
    assert one(spark, T.last_match(F.col("t"), r"(\d+)/3915"), t="none") is None
    assert one(spark, remap_label(F.col("t")), t=" Grief ") == "Sadness"
    assert one(spark, remap_label(F.col("t")), t=" ") is None
    with pytest.raises(Exception, match="outside the taxonomy: grieving"):
        one(spark, remap_label(F.col("t")), t="grieving")
    assert one(spark, label_code(F.col("t"), ["x", "y"]), t="z") == 2


def lcs_brute(a, b):
    for size in range(min(len(a), len(b)), 0, -1):
        for left in itertools.combinations(a, size):
            it = iter(b)
            if all(x in it for x in left):
                return size
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_lcs(a, b):
    assert kernels.lcs_length(a, b) == lcs_brute(a, b)


def dtw_brute(cost):
    n, m = cost.shape
    dp = np.full((n + 1, m + 1), np.inf)
    dp[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            dp[i, j] = cost[i - 1, j - 1] + min(dp[i - 1, j], dp[i, j - 1], dp[i - 1, j - 1])
    return dp[n, m]


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (5, 1), (7, 4), (9, 9)])
def test_dtw(n, m):
    cost = np.random.default_rng(n * 10 + m).random((n, m))
    assert kernels.dtw_cost(cost) == pytest.approx(dtw_brute(cost))


@pytest.mark.parametrize("k, n", [(0, 1), (3, 10), (49, 100), (10, 10)])
def test_binomial_tail(k, n):
    assert kernels.binomial_half_tail(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-10)


def test_student_t():
    assert kernels.t_critical(2) == pytest.approx(4.302652729911275, abs=1e-8)
    assert kernels.t_critical(4) == pytest.approx(2.7764451051977934, abs=1e-8)
    for t in (0.3, 1.7, 5.0):
        assert kernels.t_two_sided(t, 2) == pytest.approx(2 * (0.5 - t / (2 * math.sqrt(2 + t * t))), abs=1e-12)


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"),
    ("rational", "ration"), ("electrical", "electr"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("was", "was")])
def test_porter(word, stem):
    assert porter.stem(word) == stem
