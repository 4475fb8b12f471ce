"""Clustering, hard negatives and line deduplication against brute force."""
import collections
import hashlib
import itertools
import math

import numpy as np
import pytest

from narralytics.llm import centroids, hard_negatives, line_dedup
from narralytics.llm.queries import QUERIES, SQL
from narralytics.session import Scratch, scratch_path
from tests.llm.helpers import awkward, count, empty, rows
from tests.oracle import connect

VECTORS = "vec_id long, embedding array<double>, label int, distance string, width string, cell string, score string, rank string"


def vectors(spark, items):
    """Rows (vec_id, embedding, label); extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "d", "w", "c", "s", "r")
                                  for i, v, y in items], VECTORS)


def odd_vectors(width):
    fine = [0.25] * width
    return [(1, None, 1), (2, [], 1), (3, [*fine[1:], None], 1), (4, [*fine[1:], float("nan")], 1), (5, [*fine[1:], float("-inf")], 1),
            (6, [0.5] * (width + 1), 1), (None, fine, 1), (7, fine, None), (8, [0.0] * width, 2), (8, [0.0] * width, 2)]


def same_as_sql(spark, name, sf_dir):
    con = connect(sf_dir)
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(SQL[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert collections.Counter(map(tuple, got.select([d[0] for d in want.description]).collect())) == collections.Counter(want.fetchall())


@pytest.mark.parametrize("name", ["op11_centroids", "op12_hard_negatives", "op13_line_dedup"])
def test_query_equals_its_sql(spark, sf_dir, name):
    same_as_sql(spark, name, sf_dir)


# clustering

def plain_clusters(items, k, rounds, width, scale=256, tag="2"):
    """Final clusters by id, every distance computed with Python integers."""
    xs = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in items
          if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"{tag}:{i}".encode()).hexdigest(), n, v) for n, (i, v) in enumerate(xs) if i is not None)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in xs:
            groups[nearest(v)[1]].append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    found = [(i, *nearest(v)) for i, v in xs]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


@pytest.mark.parametrize("kind", ["spread", "tied", "groups", "few"])
def test_clusters_equal_plain_version(spark, kind):
    rng = np.random.default_rng(5)
    width, n = 6, 3 if kind == "few" else 260
    if kind == "tied":          # many equal vectors and equal distances
        data = rng.integers(-2, 3, (n, width)) / 256
    elif kind == "groups":
        data = rng.normal(size=(8, width))[rng.integers(0, 8, n)] + rng.normal(size=(n, width)) / 50
    else:
        data = rng.normal(size=(n, width))
    items = [(i, row.tolist(), 1) for i, row in enumerate(data)] + [x for x in odd_vectors(width) if x[0] != 8]
    items = [x for x in items if x[0] is not None]
    assert rows(centroids.cluster(vectors(spark, items), k=12, rounds=4, width=width)) == plain_clusters(items, 12, 4, width)


def test_clusters_awkward_rows(spark):
    got = centroids.cluster(vectors(spark, odd_vectors(4)), k=40, rounds=2, width=4).collect()
    assert sorted(str(r.vec_id) for r in got) == ["7", "8", "8", "None"] and {r.distance for r in got} == {0}
    assert count(centroids.cluster(vectors(spark, []), width=4)) == 0 and count(centroids.cluster(vectors(spark, odd_vectors(4)[:5]), width=4)) == 0
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 4, 1)]), width=4).collect()


def test_bounds_spare_most_comparisons():
    """On separated groups, later passes compare few vectors, and passes equal a full search after every move."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(10, 8))[rng.integers(0, 10, 4000)] * 4000 + rng.normal(size=(4000, 8)) * 40).astype(np.int64)
    c = x[:24].copy()
    a, b = np.zeros(4000, dtype=np.int32), np.ones(4000, dtype=np.int32)
    upper, lower = np.full(4000, np.inf), np.zeros(4000)
    for step in range(5):
        near = centroids.Neighbours(c)
        skipped = np.count_nonzero(upper < np.maximum(lower, near.half[a]))
        a, b, upper, lower = centroids.shallot(x, a, b, upper, lower, near)
        d = np.array([centroids.squared(x, m) for m in c])
        assert np.array_equal(a, d.argmin(axis=0))
        moved = c + rng.integers(-3, 4, c.shape)
        upper, lower = centroids.loosen(a, upper, lower, np.sqrt(centroids.squared(moved, c).astype(float)))
        c = moved
    assert skipped > 1000


# hard negatives

def plain_negatives(items, every, scale=256):
    xs = sorted({(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in items
                 if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, y, q in xs:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, z, v in xs if j != i and len(v) == len(q))
        for ps, j, _ in [s for s in scored if s[2] == y][:5]:
            fit = [(s, m) for s, m, z in scored if z != y and -50 * ps <= -100 * s <= -95 * ps]
            out += [(i, j, r, m, -ps, -s) for r, (s, m) in enumerate(fit[:3], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["spread", "copies", "ties", "widths"])
def test_negatives_equal_plain_version(spark, kind):
    rng = np.random.default_rng(3)
    n = 420
    data = [(rng.normal(size=6) if kind != "ties" else rng.integers(0, 3, 6) / 256).tolist() for _ in range(n)]
    if kind == "copies":        # a third of all rows are one vector, with two labels
        data[: n // 3] = [data[0]] * (n // 3)
    if kind == "widths":
        data = [v[: 3 + i % 4] for i, v in enumerate(data)]
    items = [(int(i), v, int(rng.integers(0, 3))) for i, v in zip(rng.permutation(n), data)] + odd_vectors(6) + [(10 ** 6, data[-1], 1)]
    got = hard_negatives.mine(vectors(spark, items), every=10, sample=60, shard_rows=50, block_anchors=7)
    assert rows(got) == plain_negatives(items, 10)


def test_negatives_awkward_rows(spark):
    assert count(hard_negatives.mine(vectors(spark, []))) == 0 and count(hard_negatives.mine(vectors(spark, odd_vectors(3)[:5]))) == 0
    assert rows(hard_negatives.mine(vectors(spark, odd_vectors(4)), every=1)) == plain_negatives(odd_vectors(4), 1)


def test_tree_covers_its_rows_and_skips_nodes():
    rng = np.random.default_rng(1)
    x = ((rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) / 20) * 200).astype(np.int64)
    top = float((x * x).sum(axis=1).max())
    tree = hard_negatives.CoverTree(x, top)
    assert sorted(tree.order) == list(range(4000))
    q = x[:50].astype(float)
    upper, lower = hard_negatives.bounds(q @ tree.centres.T, np.linalg.norm(q, axis=1), top, tree.cosine)
    for node, (a, b) in enumerate(tree.stretch):
        scores = q @ x[tree.order[a:b]].T.astype(float)
        assert (scores.max(axis=1) <= upper[:, node]).all() and (scores.min(axis=1) >= lower[:, node]).all()
    seen = []
    labels = np.array(["a"] * 4000, dtype=object)
    found = hard_negatives.descend(tree, x.astype(float), np.arange(4000), labels, q, np.arange(50), ["a"] * 50, [[(-np.inf, np.inf)]] * 50, 5, True, seen)
    assert sum(seen) < 50 * 4000 / 4
    for i in range(50):
        best = sorted((-float(s), j) for j, s in enumerate(x @ q[i]) if j != i)[:5]
        assert [(-s, j) for n, _, j, s in found if n == i] == best


# line deduplication

def plain_dedup(texts, min_chars=20, min_docs=3):
    """{position: (n_lines, n_dropped, sha of the kept text)} of (doc_id, text) rows."""
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))

    holders = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in texts:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = ["A line that stands in many texts, é", "  a LINE that stands in many texts, é\t", "short", "", "another line of twenty and more letters",
         "ÉCOLE: letters that stay as they are É", "école: letters that stay as they are é", "twelve words that nobody else has written down 1", "x" * 19, "x" * 20]


def texts_of(rng, n, first=0):
    return [(first + i, "\n".join(rng.choice(LINES, rng.integers(0, 12))) + f"\nonly text {first + i} has this line of its own") for i in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "k", "n") for i, t in texts], "doc_id long, text string, k1 string, n string")


def test_lines_equal_plain_version(spark):
    rng = np.random.default_rng(2)
    texts = texts_of(rng, 60) + [(3, LINES[4]), (3, None), (None, "\n".join(LINES)), (500, None), (501, ""), (502, "\n".join(LINES * 400)), (503, "\r\n" * 50)]
    assert rows(line_dedup.deduplicate(docs_of(spark, texts), shard_keys=8)) == plain_dedup(texts)
    strange = [tuple(r)[:2] for r in awkward(spark).collect()]
    assert rows(line_dedup.deduplicate(awkward(spark))) == plain_dedup(strange)
    assert count(line_dedup.deduplicate(empty(spark))) == 0


def state_of(index):
    return rows(index.references()), rows(index.reference_counts())


def applied(index, texts, spark):
    got = index.apply(docs_of(spark, texts)).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=repr)


def test_insertions_and_deletions_are_reversible(spark):
    rng = np.random.default_rng(4)
    first, second, third = texts_of(rng, 25), texts_of(rng, 20, 100), texts_of(rng, 30, 50)
    index = line_dedup.LineIndex(spark, shard_keys=8).insert(docs_of(spark, first))
    before = state_of(index)
    assert applied(index, first, spark) == plain_dedup(first)
    index.insert(docs_of(spark, second)).insert(docs_of(spark, third))
    assert applied(index, first + second + third, spark) == plain_dedup(first + second + third)
    gone = spark.createDataFrame([(i,) for i, _ in third] + [(None,), (12345,)], "doc_id long")
    index.delete(gone)
    assert applied(index, first + second, spark) == plain_dedup(first + second)
    reopened = line_dedup.LineIndex.open(spark, index.path, shard_keys=8)
    reopened.delete(spark.createDataFrame([(i,) for i, _ in second], "doc_id long"))
    assert state_of(reopened) == before and reopened.keys == len(before[1])
    assert applied(reopened, first, spark) == plain_dedup(first)
    reopened.insert(docs_of(spark, second)).insert(docs_of(spark, second))       # again, and twice
    assert applied(reopened, first + second, spark) == plain_dedup(first + second)
    reopened.delete(docs_of(spark, first + second))
    assert state_of(reopened) == ([], []) and reopened.keys == 0
    assert count(spark.read.parquet(reopened.filters)) == 0                      # all fingerprints are out again


def test_filters_ask_the_tables_only_for_keys_that_may_be_present(spark, monkeypatch):
    asked = []
    recount = line_dedup.LineIndex._recount
    monkeypatch.setattr(line_dedup.LineIndex, "_recount", lambda self, keys, refs: asked.append(keys.count()) or recount(self, keys, refs))
    old = [(i, "\n".join(f"line {j} of old text {i} stands alone" for j in range(40))) for i in range(20)]
    new = [(100 + i, "\n".join(f"line {j} of new text {i} stands alone" for j in range(40))) for i in range(20)] + [(999, old[0][1])]
    index = line_dedup.LineIndex(spark, shard_keys=200).insert(docs_of(spark, old)).insert(docs_of(spark, new))
    assert index.keys == 1600 and 40 <= max(asked) < 60
    assert applied(index, old + new, spark) == plain_dedup(old + new)


@pytest.mark.parametrize("buckets", [4, 64, 4096])
def test_filter_holds_what_it_was_given(buckets, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART_BUCKETS", buckets)
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, 3000))
    held = line_dedup.Filter([])
    for part in np.array_split(keys, 7):
        held.add(part)
    assert held.holds(keys).all()
    held = line_dedup.Filter(held.blobs())
    held.remove(keys[::2])
    assert held.holds(keys[1::2]).all()
    others = rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    assert held.holds(others).mean() < 0.001 * max(1, len(held.parts))
    held.remove(keys[1::2])
    assert held.blobs() == []


def test_equal_fingerprints_spill_and_leave_again():
    held = line_dedup.Filter([])
    key = np.array([77], dtype=np.int64)
    for _ in range(40):        # forty keys of one fingerprint and one bucket
        held.add(key)
    for left in range(40, 0, -1):
        assert held.holds(key).all() and sum(np.count_nonzero(p.cells) for p in held.parts) == left
        held.remove(key)
    assert not held.holds(key).any()


def test_scratch_tables_go_when_dropped(spark):
    scratch = Scratch(spark)
    kept = scratch.write(spark.range(3), "a")
    assert kept.count() == 3
    with pytest.raises(ValueError):
        scratch.write(spark.range(3), "a")
    scratch.clear()
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0] if scratch.paths else scratch_path(spark, "a")).count()


def test_pairs_of_equal_rows_stand_once(spark):
    pairs = list(itertools.repeat((1, "\n".join(LINES)), 5))
    assert rows(line_dedup.deduplicate(docs_of(spark, pairs))) == plain_dedup(pairs)
