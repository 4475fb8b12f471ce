"""The keyed score cache: what a lookup reads, what appends leave."""
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from narralytics.operators.score_cache import ScoreCache, score_with_stored_cache


def key(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def scores(spark, ids, score=0):
    return spark.createDataFrame([(key(i), i, score + i) for i in ids], "cache_key string, id long, score long").select("cache_key", "score")


def keys(spark, ids):
    return spark.createDataFrame([(i, key(i)) for i in ids], "id long, cache_key string")


@pytest.fixture
def cache(spark, tmp_path):
    return ScoreCache(spark, str(tmp_path / "cache"), "score long")


def test_lookup_reads_only_touched_prefixes(spark, cache):
    cache.append(scores(spark, range(3000)))
    assert len(cache.places()) == 256
    asked = keys(spark, [1, 5, 9, 2999, 5, 7, 100_000, 100_001, 100_002, 100_003])
    hits, misses = cache.lookup(asked)
    files = {Path(f).parent.name for f in hits.inputFiles() if "prefix=" in f}
    assert files == {f"prefix={key(i)[:2]}" for i in (1, 5, 9, 2999, 7, 100_000, 100_001, 100_002, 100_003)} and len(files) <= 10
    assert sorted((r.id, r.score) for r in hits.collect()) == [(1, 1), (5, 5), (5, 5), (7, 7), (9, 9), (2999, 2999)]
    assert sorted(r.id for r in misses.collect()) == [100_000, 100_001, 100_002, 100_003]


def test_appends_leave_one_row_per_key(spark, cache):
    cache.append(scores(spark, [1, 2, 3]).unionByName(scores(spark, [2, 3], 50)))
    cache.append(scores(spark, [3, 4], 100).unionByName(spark.createDataFrame([(None, 1)], "cache_key string, score long")))
    got = {r.cache_key: r.score for r in cache.read().collect()}
    assert cache.read().count() == 4 and got == {key(1): 1, key(2): 2, key(3): 3, key(4): 104}     # what is there stays; of new rows the smallest
    before = cache.places()
    cache.append(scores(spark, [1]))
    after = cache.places()
    assert {p for p in after if after[p] != before[p]} == {key(1)[:2]}                              # other prefixes are not rewritten
    cache.append(scores(spark, []))
    assert cache.places() == after


def test_unfinished_generation_counts_for_nothing(spark, cache):
    cache.append(scores(spark, [1, 2]))
    half = Path(cache.path.replace("file:", "")) / "g=000000000009" / f"prefix={key(1)[:2]}"
    half.mkdir(parents=True)
    assert sorted(r.score for r in cache.read().collect()) == [1, 2]
    cache.append(scores(spark, [3]))
    assert sorted(r.score for r in cache.read().collect()) == [1, 2, 3]


def test_empty_cache_and_scoring(spark, cache):
    asked = keys(spark, [1, 2, 3])
    hits, misses = cache.lookup(asked)
    assert hits.count() == 0 and misses.count() == 3
    calls = spark.sparkContext.accumulator(0)

    def score(rows):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pdf.assign(score=pdf["id"] * 10)
        return rows.mapInPandas(run, "id long, cache_key string, score long")

    cache.append(scores(spark, [2]))
    assert sorted((r.id, r.score) for r in score_with_stored_cache(asked, cache, score).collect()) == [(1, 10), (2, 2), (3, 30)]
    assert sorted((r.id, r.score) for r in score_with_stored_cache(asked, cache, score).collect()) == [(1, 10), (2, 2), (3, 30)]
    assert calls.value == 2 and cache.read().agg(F.count("*")).first()[0] == 3
