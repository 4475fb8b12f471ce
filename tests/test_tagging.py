"""Many topic rules: literals against patterns, and the cost of their number."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from narralytics.functions.text import tag_topics
from narralytics.operators import tagging as T


@pytest.mark.parametrize("pattern, texts", [
    ("tax", ["tax"]), (r"(?i)\btax reform\b", ["tax reform"]), (r"\b(vote|poll|ballot box)\b", ["vote", "poll", "ballot box"]), (r"(?i)(?:a\.b|c\+)", ["a.b", "c+"]),
    ("ta?x", None), (r"\d+", None), ("^tax", None), (r"[a-z]", None), ("(a|b)c", None), ("(a|)", None), ("", None), (r"a\b", ["a"]), (r"tax\\", ["tax\\"]), ("a|b", None)])
def test_which_patterns_are_literals(pattern, texts):
    got = T.literals(pattern)
    assert (got and [x.text for x in got]) == texts


RULES = [("plain", "ner"), ("word", r"\bthe\b"), ("any", r"(?i)THE"), ("group", r"(?i)\b(river|stone lamp)\b"), ("pattern", r"[0-9]{3,}"), ("left", r"\bsto"), ("dot", r"a\.b"),
         ("overlap", "iver s"), ("upper", "River"), ("start", "^the"), ("accent", "é"), ("never", "zzz")]


def test_tags_equal_patterns_tried_one_by_one(spark):
    rng = random.Random(3)
    words = ["the", "The", "other", "river", "River", "stone", "lamp", "corner", "12", "1234", "a.b", "a-b", "été", "_the_", "the,", "stone lamp", "(river)"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(400)] + [None, "", "the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    both = df.select("text", T.tag_many(F.col("text"), RULES).alias("many"), tag_topics(F.col("text"), RULES).alias("each")).collect()
    assert all(r["many"] == (r["each"] or "") for r in both) and len({r["many"] for r in both}) > 40
    plain = df.select("text", T.tag_many(F.col("text"), RULES[:4]).alias("many")).collect()
    assert all(r["many"] == ",".join(n for n, p in RULES[:4] if re.search(p.replace("(?i)", ""), r["text"] or "", re.I * ("(?i)" in p))) for r in plain)
    assert T.tag_documents_by_rules(df, [("none", "zzz")], require_topic=True).count() == 0


def test_five_thousand_rules_cost_less_than_twice_fifty(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 11))) for _ in range(20_000)]
    others = ["".join(rng.choice("ijklmnopqrst") for _ in range(rng.randrange(8, 14))) for _ in range(4950)]     # hardly any of them occurs
    words = [*vocabulary[:50], *others]
    texts = spark.createDataFrame([(" ".join(rng.choice(vocabulary) for _ in range(300)),) for _ in range(4000)], "text string")
    df = texts.crossJoin(spark.range(4)).select("text").repartition(8).cache()
    df.count()
    seconds = {}
    for _ in range(3):
        for n in (50, 5000):
            rules = [(f"r{i}", rf"\b{w}\b") for i, w in enumerate(words[:n])]
            start = time.perf_counter()
            df.select(F.sum(F.length(T.tag_many(F.col("text"), rules)))).collect()
            seconds[n] = min(seconds.get(n, 1e9), time.perf_counter() - start)
    assert seconds[5000] < 2 * seconds[50], seconds
