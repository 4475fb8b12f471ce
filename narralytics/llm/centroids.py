"""Centroid clustering of integer vectors by Shallot search.

Vectors become integers, floor(scale * x), so that every distance, tie and mean is exact. A round is one narrow Spark pass over the vectors with
their state and one small aggregate: the state of a vector is its centroid, the second-nearest centroid it remembers, an upper bound of the
distance to the first and a lower bound of the distance to all others. Centroid moves loosen the bounds; a vector whose upper bound
stays below its lower bound, or below half the gap to the nearest other centroid, is not compared with anything. The rest start at the
closer one of the two remembered centroids and scan the others in order of their distance from it, within a ball of radius (nearest + second nearest
distance so far) that shrinks while better ones are found. Whoever survives the bounds is compared by its squared distance in integers, ties
going to the smaller number. Only the centroids and their sums (``k`` rows of ``width`` numbers) reach the driver. Every pass is
written to the shared folder and the pass before it deleted.

Defined results: vectors that are null, of another width, or hold null or non-finite components are left out. Repeated rows are vectors each. The first
centroids are the ``k`` vectors of smallest sha256 of "<tag>:<vec_id>", ties by the vector, null ids last; with fewer vectors than ``k`` each is
one. Empty clusters keep their centroid. A null vec_id stays null in the result. An empty table gives an empty result. Components
from 2**27 on after scaling raise an error, since squared distances would leave 64 bits. Further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.llm.embed_dedup import matrix
from narralytics.session import Scratch

WIDTH = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
TAG = "2"
LIMIT = 1 << 27      # components stay below: 64 squared differences fit 62 bits
SLACK = 1e-12        # relative room for rounding in the bounds; distances themselves are exact
BATCH = 8192
STATE = "vec_id long, v array<int>, a int, b int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vector: Column, scale: int, limit: int) -> Column:
    """array<int>: floor(scale * x) of every component, computed in double precision."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    wide = F.exists(vector, lambda x: F.abs(x.cast("double")) * float(scale) >= float(limit))
    return F.when(wide, F.raise_error(F.lit(f"vector component of {limit} or more after scaling"))).otherwise(scaled).cast("array<int>")


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components; false for null vectors."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Neighbours:
    """The centroids, for each the others by distance, and half the gap to the nearest."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        k = len(centroids)
        d = np.sqrt(np.array([squared(centroids, c) for c in centroids], dtype=float))
        np.fill_diagonal(d, -1.0)                       # the centroid itself comes first and is cut off
        self.order = np.argsort(d, axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(d, self.order, axis=1)
        self.half = self.gap[:, 0] * (0.5 - SLACK) if k > 1 else np.full(k, np.inf)


def loosen(a, upper, lower, moves: np.ndarray):
    """Bounds after the centroids moved: the own one away, the farthest-moving other one nearer."""
    top = np.argsort(-moves, kind="stable")
    other = np.where(a == top[0], moves[top[1]] if len(moves) > 1 else 0.0, moves[top[0]])
    upper = (upper + moves[a]) * (1 + SLACK)
    lower = np.maximum(lower - other - SLACK * (lower + other), 0.0)
    return upper, lower


def shallot(x, a, b, upper, lower, near: Neighbours):
    """(a, b, upper, lower) after one pass; nearest centroids are exact, ties go to the smaller number."""
    a, b, upper, lower = a.copy(), b.copy(), upper.copy(), lower.copy()
    todo = np.flatnonzero(~(upper < np.maximum(lower, near.half[a])))
    exact = squared(x[todo], near.c[a[todo]])
    upper[todo] = np.sqrt(exact) * (1 + SLACK)
    open_ = ~(upper[todo] < np.maximum(lower[todo], near.half[a[todo]]))
    todo, d1 = todo[open_], exact[open_]
    if not len(todo):
        return a, b, upper, lower
    first, second = a[todo], b[todo]
    d2 = squared(x[todo], near.c[second])
    swap = (d2 < d1) | ((d2 == d1) & (second < first))   # the closer of the two remembered is the centre of the search
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    centre, partner, reach = first.copy(), second.copy(), np.sqrt(d1)
    active = np.arange(len(todo))
    for step in range(near.order.shape[1]):
        inside = near.gap[centre[active], step] <= (reach[active] + np.sqrt(d2[active])) * (1 + SLACK)
        active = active[inside]
        if not len(active):
            break
        j = near.order[centre[active], step]
        fresh = j != partner[active]
        rows, j = active[fresh], j[fresh]
        d = squared(x[todo[rows]], near.c[j])
        best = (d < d1[rows]) | ((d == d1[rows]) & (j < first[rows]))
        r = rows[best]
        second[r], d2[r] = first[r], d1[r]
        first[r], d1[r] = j[best], d[best]
        runner = ~best & (d < d2[rows])
        r = rows[runner]
        second[r], d2[r] = j[runner], d[runner]
    a[todo], b[todo] = first, second
    upper[todo], lower[todo] = np.sqrt(d1) * (1 + SLACK), np.sqrt(d2) * (1 - SLACK)
    return a, b, upper, lower


def _pass(state: DataFrame, near: Neighbours, moves: np.ndarray | None) -> DataFrame:
    """The state after one assignment of every vector."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                a, b, upper, lower = (batch.column(c).to_numpy() for c in ("a", "b", "upper", "lower"))
                if moves is not None:
                    upper, lower = loosen(a, upper, lower, moves)
                done = shallot(matrix(batch.column("v")), a, b, upper, lower, near)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(done[0], pa.int32()), pa.array(done[1], pa.int32()),
                                                  pa.array(done[2]), pa.array(done[3])], ["vec_id", "v", "a", "b", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Size and exact component sums per cluster; tasks add up their rows first."""
    def run(batches):
        size, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            a = batch.column("a").to_numpy()
            size += np.bincount(a, minlength=k)
            np.add.at(total, a, matrix(batch.column("v")).astype(np.int64))
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))],
                                         ["a", "n", "total"])

    parts = state.select("a", "v").mapInArrow(run, "a int, n long, total array<long>")
    by_place = parts.select("a", "n", F.posexplode("total").alias("place", "x")).groupBy("a", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    size, total = np.zeros(k, dtype=np.int64), [[0] * width for _ in range(k)]
    for r in by_place.collect():      # k * width rows
        size[r["a"]], total[r["a"]][r["place"]] = r["n"], r["x"]
    return size, total


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, tag: str = TAG) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of ``vectors`` (vec_id, embedding)."""
    spark, scratch, v = vectors.sparkSession, Scratch(vectors.sparkSession), F.col("embedding")
    usable = vectors.where(finite(v) & (F.size(v) == width)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(v, scale, LIMIT).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")), 256)
    seeds = usable.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()   # k rows
    if not seeds:
        return spark.createDataFrame([], RESULT)
    c = np.array([r["v"] for r in seeds], dtype=np.int64)
    start = usable.select("vec_id", "v", F.lit(0).alias("a"), F.lit(min(1, len(c) - 1)).alias("b"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    state, moves = scratch.write(_pass(start, Neighbours(c), None), "clusters-0"), None
    for i in range(rounds):
        size, total = _sums(state, len(c), width)
        moved = np.array([[x // int(n) for x in t] if n else list(old) for n, t, old in zip(size, total, c)], dtype=np.int64)
        moves, c = np.sqrt(squared(moved, c).astype(float)) * (1 + SLACK), moved
        state = scratch.write(_pass(state, Neighbours(c), moves), f"clusters-{i + 1}")
        scratch.drop(f"clusters-{i}")

    def measure(batches):
        for batch in batches:
            a = batch.column("a").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("a"), pa.array(squared(matrix(batch.column("v")), c[a]))],
                                             ["vec_id", "cluster", "distance"])

    measured = state.mapInArrow(measure, "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}   # k rows
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    per = spark.createDataFrame([(i, s, sum(inertia.values()), sha[i]) for i, s in inertia.items()],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
