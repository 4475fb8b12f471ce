"""Density topics against a plain version."""
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from narralytics.functions import kernels
from narralytics.operators import density as D
from narralytics.operators import similarity as N


def table(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")


def plain_graph(points, k):
    """Core distances and neighbour edges by comparing all pairs."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    d = np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit.T)))
    n = len(points)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (-sims[i, j], j))[:k] for i in range(n)]
    core = [max((d[i, j] for j in near[i]), default=0.0) for i in range(n)]
    return core, {(min(i, j), max(i, j)): max(d[i, j], core[i], core[j], D.CLOSEST) for i in range(n) for j in near[i]}


def plain_forest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return out


def plain_topics(n, forest, min_size, allow_single=False):
    """The binary merge tree first, then from its roots down: splits into two large parts, masses, best clusters."""
    node = {i: (i,) for i in range(n)}          # (leaf,) or (weight, left, right)
    where, rows = {i: i for i in range(n)}, {i: [i] for i in range(n)}
    for a, b, w in forest:
        x, y = where[a], where[b]
        key = ("m", a, b)
        node[key], rows[key] = (w, x, y), rows[x] + rows[y]
        for r in rows[key]:
            where[r] = key
    roots = sorted(set(where.values()), key=str)

    def cluster(start, birth):
        """(mass, labelled parts) of the best choice below and including the cluster that begins at ``start``."""
        mass, at = 0.0, start
        while True:
            if len(node[at]) == 1:
                return mass, [], rows[start]
            w, x, y = node[at]
            density = 1 / w
            large = [c for c in (x, y) if len(rows[c]) >= min_size]
            if len(large) == 2:
                mass += len(rows[at]) * (density - birth)
                parts = [cluster(c, density) for c in (x, y)]
                below = sum(p[0] for p in parts)
                kept = [q for p in parts for q in p[1]]
                return (mass, [rows[start]], None) if mass >= below else (below, kept, None)
            if not large:
                mass += len(rows[at]) * (density - birth)
                return mass, [rows[start]], None
            mass += (len(rows[at]) - len(rows[large[0]])) * (density - birth)
            at = large[0]

    def top(start, alone):
        at = start
        if alone and not allow_single:
            while len(node[at]) == 3 and sum(len(rows[c]) >= min_size for c in node[at][1:]) == 1:
                at = next(c for c in node[at][1:] if len(rows[c]) >= min_size)
            if len(node[at]) == 3 and all(len(rows[c]) >= min_size for c in node[at][1:]):
                return [q for c in node[at][1:] for q in cluster(c, 1 / node[at][0])[1]]
            return []
        return cluster(start, 0.0)[1]

    found = [q for r in roots if len(rows[r]) >= min_size for q in top(r, len(roots) == 1)]
    label = {i: -1 for i in range(n)}
    for t, part in enumerate(sorted(found, key=lambda p: (-len(p), min(p)))):
        label.update({i: t for i in part})
    return label


def points_of(kind, n=500):
    rng = np.random.default_rng(12)
    if kind == "noise":
        return rng.normal(size=(n, 5))
    sizes = [120, 90, 60, 40, 10]
    groups = [rng.normal(size=5) * 3 + rng.normal(0, 0.1 + 0.05 * i, (s, 5)) for i, s in enumerate(sizes)]
    points = np.vstack([*groups, rng.normal(size=(n - sum(sizes), 5))])
    if kind == "copies":
        points[:150] = points[0]
    return points


@pytest.mark.parametrize("kind, band", [("groups", 1_000_000), ("groups", 57), ("copies", 100), ("noise", 130)])
def test_topics_equal_plain_version(spark, kind, band):
    points = points_of(kind)
    core, edges = plain_graph(points, 6)
    vectors = table(spark, points)
    neighbours = D.nearest_others(vectors, 6)
    got = {r["id"]: r["core"] for r in D.core_distances(neighbours, 6).collect()}
    assert got == pytest.approx(dict(enumerate(core)), abs=1e-7)
    out = {r["id"]: r["topic_id"] for r in D.density_topics(vectors, 6, 25, band).collect()}
    # the plain tree is built from the same weights, so that rounding cannot reorder equal edges
    near = D.nearest_others(vectors, 6)
    weights = {(r.a, r.b): r.w for r in D.reachability_edges(near, D.core_distances(near, 6)).collect()}
    assert weights == pytest.approx(edges, abs=1e-7)
    assert out == plain_topics(len(points), plain_forest(weights), 25)
    assert kind == "noise" or len(set(out.values())) >= 4 and -1 in out.values()


def test_forest_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    edges = {(int(min(a, b)), int(max(a, b))): float(rng.integers(1, 9)) for a, b in rng.integers(0, 150, (320, 2)) if a != b}   # many equal weights
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")
    assert sorted((r.a, r.b, r.w) for r in D.spanning_forest(df).collect()) == sorted(plain_forest(edges))
    assert D.spanning_forest(df.limit(0)).count() == 0


@pytest.mark.parametrize("single", [True, False])
def test_one_group_and_small_tables(spark, single):
    rng = np.random.default_rng(1)
    one = table(spark, rng.normal(size=6) + rng.normal(0, 0.05, (60, 6)))
    out = [r["topic_id"] for r in D.density_topics(one, 5, 40, allow_single=single).collect()]
    assert len(out) == 60 and set(out) == ({0} if single else {-1})
    for n in (0, 1, 2):
        assert [r["topic_id"] for r in D.density_topics(table(spark, rng.normal(size=(n, 3))), 5, 40).collect()] == [-1] * n


def test_topic_study_by_density(spark, sf_dir):
    from narralytics.operators.topics import policy_codebook
    from narralytics.plans.corpus_topics import study_topics

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "CAST(size(split(text, ' ')) AS STRING) AS word_count")
    study = study_topics(docs, "doc_id", policy_codebook(spark), min_size=8, min_topics=1, method="density", min_samples=3)
    assigned = study.assignments.select("doc_id", "topic_id").collect()
    topics = {r.topic_id for r in assigned}
    assert -1 in topics and len(topics) >= 3 and len(assigned) == len({r.doc_id for r in assigned})
    assert {r.topic_id for r in study.summary.select("topic_id").collect()} == topics - {-1}
    assert all(sum(r.topic_id == t for r in assigned) >= 8 for t in topics - {-1})
    with pytest.raises(ValueError, match="unknown method"):
        study_topics(docs, "doc_id", policy_codebook(spark), method="other")


def test_nearest_rows_are_found_in_bounded_memory():
    rng = np.random.default_rng(3)
    left, right, ids = rng.integers(-2, 3, (2500, 4)).astype(float), rng.integers(-2, 3, (12_000, 4)).astype(float), rng.permutation(12_000)   # many ties, some zero vectors
    unit = kernels.unit_rows(right)
    tracemalloc.start()
    got = N._top_frame(pd.Series(np.arange(len(left))), left, ids, unit, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 220 << 20, peak      # all scores at once are 229 MB, and as much again for their order
    scores = np.round(kernels.unit_rows(left[::50]) @ unit.T, 12)
    want = [[i * 50, x] for i, row in enumerate(scores) for x in ids[np.lexsort((ids, -row))[:5]]]
    assert got[got.left_id % 50 == 0][["left_id", "right_id"]].to_numpy().tolist() == want
