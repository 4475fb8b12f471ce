"""Fingerprints and vectors against comparing all pairs."""
import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from narralytics.llm import embed_dedup, graph, simhash
from narralytics.llm.common import table
from narralytics.llm.queries import QUERIES
from tests.llm.helpers import DOCS, awkward, count, documents, empty, prose


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def expected_groups(ids, values):
    """Smallest id reachable over values that differ in at most two bits."""
    n = len(ids)
    order = sorted(range(n), key=lambda i: ids[i])
    linked = [(a, b) for a in range(n) for b in range(a) if (values[order[a]] ^ values[order[b]]).bit_count() <= 2]
    root = plain_components(n, linked)
    return {ids[order[i]]: ids[order[root[i]]] for i in range(n)}


def test_fingerprint_equals_plain_definition():
    for text in ("", "a", "A b", "a b c", prose(3, 700), "É É é x\x0by\x1cz", "w " * 3000):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash_query_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    values = [plain_fingerprint(d.text) for d in docs]
    want = expected_groups([d.doc_id for d in docs], values)
    got = QUERIES["op1_simhash"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {d.doc_id: f"{v:016x}" for d, v in zip(docs, values)}


def test_simhash_awkward_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(awkward(spark)).collect()]
    zero = sorted((r for r in got if r[1] == "0" * 16), key=lambda r: r[0])
    assert [r[0] for r in zero] == [1, 2, 3] and {r[2] for r in zero} == {1}
    assert len(got) == 8 and sum(r[0] == 4 and r[2] == 4 for r in got) == 2
    assert [r[2] for r in got if r[0] is None] == [None]
    assert count(simhash.near_duplicates(empty(spark))) == 0


def test_keep_first_leaves_one_of_each_group(spark):
    kept = simhash.keep_first(awkward(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"] and kept.columns == awkward(spark).columns
    near = documents(spark, [prose(1, 300), prose(1, 300) + " last", prose(2, 300), prose(1, 300)])
    assert {r.doc_id for r in simhash.keep_first(near).collect()} == set(expected_groups(
        range(4), [plain_fingerprint(r.text) for r in near.collect()]).values())


@pytest.mark.parametrize("spread", [2, 5, 64])
def test_tree_finds_every_pair(spark, spread):
    """Tight groups, chains and noise, over several shards and with splits inside a shard."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    values = set()
    for c in centres.tolist():
        for _ in range(30):
            v = c
            for b in rng.integers(0, spread, int(rng.integers(0, 4))):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    linked = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_rows=32)
    roots = {r.node: r.component for r in graph.components(linked).collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = plain_components(len(values), pairs)
    groups = lambda label: sorted(sorted(i for i in range(len(values)) if label(i) == x) for x in {label(i) for i in range(len(values))})
    assert groups(lambda i: roots.get(signed[i], signed[i])) == groups(lambda i: want[i])


@pytest.mark.parametrize("oversize, shard", [(16, 8), (1, 8), (1, 2), (0, 4)])
def test_crowded_buckets_are_split_exactly(spark, monkeypatch, oversize, shard):
    """Fingerprints that share whole blocks of bits: buckets are keyed anew, and at last dealt to a tree."""
    monkeypatch.setattr(simhash, "OVERSIZE", oversize)
    rng = np.random.default_rng(shard)
    values = set()
    for keep in (0, (1 << 22) - 1, ((1 << 43) - 1) ^ ((1 << 21) - 1)):     # the bits that all of a family have in common
        base = int(rng.integers(0, 1 << 62))
        for v in rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist():
            v = base & keep | v & ~keep & ((1 << 64) - 1)
            values |= {v, v ^ 1 << int(rng.integers(0, 64)) ^ 1 << int(rng.integers(0, 64))}
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    table_ = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.component for r in graph.components(simhash.links(table_, shard_rows=shard)).collect()}
    want = plain_components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    label = [roots.get(v, v) for v in signed]
    assert {(want[i], want[j]) for i in range(len(values)) for j in range(i) if label[i] == label[j]} == {
        (want[i], want[j]) for i in range(len(values)) for j in range(i) if want[i] == want[j]}
    assert len(set(label)) == len(set(want))


def test_copies_per_fingerprint_do_not_grow(spark):
    for n in (20_000, 160_000):
        random = spark.range(n).select(F.xxhash64("id").alias("fp"))
        sent = simhash.partitioned(random, n)
        assert sent.count() == 3 * n and sent.groupBy("block", "key").count().agg(F.max("count")).first()[0] < 3 * simhash.SHARD_ROWS * simhash.BUCKET_SHARDS


def test_keep_first_loses_no_text_of_a_repeated_id(spark):
    a, b = prose(1, 300), prose(2, 300)
    texts = [(1, a), (1, b), (1, a), (2, a + " last"), (3, b), (None, prose(3, 200)), (None, prose(3, 200)), (None, prose(4, 200)), (None, b), (None, None), (None, "")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(
        [(i, t, "en", "s", 0, "f", "x", "y") for i, t in texts], DOCS)).collect()), key=repr)
    linked = [plain_fingerprint(a), plain_fingerprint(a + " last"), plain_fingerprint(b)]
    assert (linked[0] ^ linked[1]).bit_count() <= 2 < (linked[0] ^ linked[2]).bit_count()
    assert [k for k in kept if k[1]] == sorted([(1, a), (1, b), (None, prose(3, 200)), (None, prose(4, 200))], key=repr)
    assert len([k for k in kept if not k[1]]) == 1


def test_large_shard_is_split_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 2000)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 1, dtype=np.uint64)[0]
    points = np.unique(base ^ (np.uint64(1) << rng.integers(0, 12, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 600).astype(np.uint64))
                       ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    home, guest = points[::2], points[1::2]
    i, j = simhash.close_pairs(home, guest)
    everyone = np.concatenate([home, guest])
    want = {(a, b) for a in range(len(home)) for b in range(len(everyone)) if a != b and int(everyone[a] ^ everyone[b]).bit_count() <= 2}
    got = set(zip(i.tolist(), j.tolist()))
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}


def test_components_of_a_long_chain_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(None, 3), (7, None), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}


VECTORS = "vec_id long, embedding array<float>, label int, cls long, codes string"


def plain_links(rows, threshold=0.93):
    def clean(r):
        e = r[1]
        return r[0] is not None and r[2] is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    unit = {i: np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) for i, r in enumerate(rows) if clean(r)}
    return [(i, j) for i in unit for j in unit if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]


def vector_rows(groups=6, copies=12, width=24, noise=0.06, singles=40):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=width)
        for _ in range(copies):
            rows.append((len(rows), (centre + noise * np.linalg.norm(centre) / np.sqrt(width) * 4 * rng.normal(size=width)).tolist(), g % 2, 0, "c"))
    rows += [(len(rows) + i, rng.normal(size=width).tolist(), int(rng.integers(0, 2)), 0, "c") for i in range(singles)]
    rows += [(1000 + i, rows[i][1], rows[i][2], 0, "c") for i in range(3)]  # exact copies
    return rows


@pytest.mark.parametrize("tile_rows", [2048, 8])
def test_vectors_against_all_pairs(spark, tile_rows):
    rows = vector_rows()
    want = plain_links(rows)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), tile_rows=tile_rows).collect()}
    exact = np.zeros(len(rows), int)
    for i, j in want:
        exact[i] += 1
        exact[j] += 1
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= exact).all() and found.sum() >= 0.97 * exact.sum() and exact.sum() > 300
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    roots = plain_components(len(rows), [(order.index(i), order.index(j)) for i, j in want])
    assert np.mean([got[rows[i][0]].component_id == rows[order[roots[k]]][0] for k, i in enumerate(order)]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 0, ""), (2, [1.0, -0.0], 1, 0, ""), (3, [1.0, 0.0], None, 0, ""), (4, None, 1, 0, ""), (5, [], 1, 0, ""),
            (6, [0.0, 0.0], 1, 0, ""), (7, [1.0, nan], 1, 0, ""), (8, [1.0, inf], 1, 0, ""), (9, [1.0, None], 1, 0, ""),
            (10, [1.0, 0.0, 0.0], 1, 0, ""), (None, [1.0, 0.0], 1, 0, ""), (11, [2.0, 0.1], 1, 0, ""), (11, [2.0, 0.1], 1, 0, ""), (12, [1.0, 0.0], 2, 0, "")]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: tuple(r)[1:] for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[11] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)) and by[None] == (0, None, False)
    assert count(embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS))) == 0


def test_vectors_that_share_an_id_are_told_apart(spark):
    rng = np.random.default_rng(7)
    a, b, c = (rng.normal(size=16).tolist() for _ in range(3))
    near = lambda v: (np.array(v) + rng.normal(size=16) / 100).tolist()
    rows = [(5, a, 1, 0, ""), (5, b, 1, 0, ""), (1, near(a), 1, 0, ""), (9, near(b), 1, 0, ""), (3, near(b), 1, 0, ""), (5, c, 1, 0, "")]
    got = collections.Counter(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == {(5, 1, 1, False): 1, (5, 2, 3, False): 1, (1, 1, 1, True): 1, (9, 2, 3, False): 1, (3, 2, 3, True): 1, (5, 0, 5, True): 1}


def test_axes_and_tables_follow_the_rows():
    assert [embed_dedup.key_shape(n) for n in (0, 10 ** 7, 10 ** 7 + 1, 10 ** 9, 10 ** 10)] == [(2, 6), (2, 6), (3, 12), (3, 12), (4, 24)]


@pytest.mark.parametrize("axes, tables", [(3, 12), (4, 24)])
def test_recall_with_more_axes(axes, tables):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embed_dedup.keys(v, tables, axes) for v in (x, 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z))
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.98


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embed_dedup.keys(x), embed_dedup.keys(0.93 * x + np.sqrt(1 - 0.93 ** 2) * z)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() >= 0.98
