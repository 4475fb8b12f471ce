"""Hard negatives by inner product: a cover tree over norm-augmented candidates.

Vectors become integers, floor(scale * x); a score is the exact integer inner product with the anchor, ties going to the smaller vec_id. Every
candidate gets one further component, sqrt(M^2 - |x|^2) with M the largest norm of its width, so that all lie on one sphere and the largest inner
products are the nearest points. A covering radius, kept as an angle, then bounds the inner products of an anchor with all that a node covers, from
above and from below.

The upper level of the tree is a net of pivots, chosen farthest first from a bounded sample in hash order; every candidate goes to its nearest pivot and
Spark measures the covering angle of each cell over all rows. An anchor is sent only to cells whose bounds reach its window. The lower bound of the
window is lifted to the k-th best score among the sampled rows, which are rows of the table like any other, so nothing is lost. Cells are cut
into shards of some ``SHARD_ROWS`` rows, anchors of a shard into blocks; each (shard, block) is one bounded task. It builds the shard's levels (farthest-first
nets of halving radius, at most ``FAN`` children, measured covering angles), descends best first, skips nodes outside all
windows of an anchor and verifies the rows of the remaining leaves by exact scores. Tasks return their best few; windows over the narrow
results keep the best of all.

Of equal vectors with one label only the first ``positives + 1`` by vec_id can be among the first of any anchor, so only these are candidates; all rows
are anchors when their id says so.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Equal rows count once. Vectors of different widths are never
compared. A row never serves an anchor with its own vec_id; several different rows of one id are rows each. A zero vector scores 0. A window that
holds no integer has no negatives. An empty table gives an empty result. Norms of 2**26 and more after scaling raise an error: below that all scores
are exact in double precision.
Further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narralytics.llm.centroids import finite, integers
from narralytics.llm.embed_dedup import matrix
from narralytics.operators.ranking import top_per_group
from narralytics.session import Scratch, spread

EVERY = 50             # anchors are the rows whose vec_id it divides
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95     # the window of a negative's score, in hundredths of the positive's
SCALE = 256
SAMPLE = 4096          # rows that pivots and first lower bounds are taken from
SHARD_ROWS = 4096
BLOCK_ANCHORS = 4096
FAN, LEAF = 16, 48
ROUNDING = 1e-9        # room for rounding in bounds, as a share of |anchor| * M
FOUND = "anchor_id long, uid long, item int, found_id long, score long"


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    """Rows on the sphere of squared radius ``top``."""
    x = v.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))])


def net(points: np.ndarray, top: float, limit: int, start: int = 0, halve: bool = True) -> tuple[list[int], np.ndarray]:
    """Centres chosen farthest first and the centre each point belongs to.

    Ends when all points lie within half the first covering radius (with ``halve``), coincide with a centre, or at ``limit`` centres.
    """
    picks, best = [start], points @ points[start]
    owner = np.zeros(len(points), dtype=np.int64)
    far = int(best.argmin())
    stop = min(top - (top - best[far]) / 4, top * (1 - 1e-12)) if halve else top * (1 - 1e-12)   # squared chord 2 (top - dot): a quarter
    while len(picks) < limit and best[far] < stop:
        dots = points @ points[far]
        nearer = dots > best
        owner[nearer], best[nearer] = len(picks), dots[nearer]
        owner[far] = len(picks)
        best[far] = top
        picks.append(far)
        far = int(best.argmin())
    return picks, owner


def bounds(dots: np.ndarray, norms: np.ndarray, top: float, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) inner products of anchors (rows) with all points within the covering angles of centres (columns)."""
    scale = np.maximum(norms * np.sqrt(top), 1e-300)[:, None]
    phi = np.clip(dots / scale, -1.0, 1.0)
    theta = np.clip(cosine - 1e-12, -1.0, 1.0)[None, :]
    along, across = phi * theta, np.sqrt(1 - phi * phi) * np.sqrt(1 - theta * theta)
    upper = np.where(phi >= theta, 1.0, along + across) + ROUNDING
    lower = np.where(phi <= -theta, -1.0, along - across) - ROUNDING
    return upper * scale, lower * scale


class CoverTree:
    """Levels of nets over one shard; a node covers a stretch of ``order``."""

    def __init__(self, v: np.ndarray, top: float) -> None:
        points = augmented(v, top)
        n = len(points)
        self.order = np.arange(n)
        centre, cosine, parent, stretch, leaf = [0], [1.0], [-1], [(0, n)], []
        at = 0
        while at < len(centre):
            a, b = stretch[at]
            rows = self.order[a:b].copy()
            cosine[at] = float((points[rows] @ points[centre[at]]).min()) / top
            own = int(np.flatnonzero(rows == centre[at])[0])
            if b - a > LEAF and cosine[at] < 1 - 1e-12:
                picks, owner = net(points[rows], top, FAN, own)
                if len(picks) > 1:
                    self.order[a:b] = rows[np.argsort(owner, kind="stable")]
                    ends = a + np.cumsum(np.bincount(owner, minlength=len(picks)))
                    for i, pick in enumerate(picks):
                        centre.append(int(rows[pick])), cosine.append(1.0), parent.append(at)
                        stretch.append((int(ends[i - 1]) if i else a, int(ends[i])))
                    leaf.append(False)
                    at += 1
                    continue
            leaf.append(True)
            at += 1
        self.centres = v[centre].astype(float)
        self.cosine, self.parent, self.stretch = np.array(cosine), np.array(parent), stretch
        self.leaf = np.flatnonzero(leaf)
        self.top = top


def descend(tree: CoverTree, v, ids, labels, q, q_ids, q_labels, windows, k: int, same: bool, seen: list[int] | None = None):
    """Best rows per anchor and window: lists of anchor number, window number, id, score.

    ``windows`` has per anchor a list of (low, high); rows of the anchor's label (``same``) or of any other, never of its own id.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", q.astype(float), q.astype(float)))
    upper, lower = bounds(q.astype(float) @ tree.centres.T, norms, tree.top, tree.cosine)
    for node in range(1, len(tree.parent)):        # parents stand before their children
        np.minimum(upper[:, node], upper[:, tree.parent[node]], out=upper[:, node])
        np.maximum(lower[:, node], lower[:, tree.parent[node]], out=lower[:, node])
    upper, lower = upper[:, tree.leaf], lower[:, tree.leaf]
    by_bound = np.argsort(-upper, axis=1, kind="stable")
    rows_of = [tree.order[a:b] for a, b in (tree.stretch[i] for i in tree.leaf)]
    out = []
    for i, wanted in enumerate(windows):
        low, high = np.array([w[0] for w in wanted], dtype=float), np.array([w[1] for w in wanted], dtype=float)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2 for _ in wanted]
        at, step = 0, 1
        while at < len(by_bound[i]) and upper[i, by_bound[i, at]] >= low.min():
            nodes = by_bound[i, at:at + step]
            at, step = at + step, step * 2
            nodes = nodes[((upper[i, nodes][:, None] >= low) & (lower[i, nodes][:, None] <= high)).any(axis=1)]
            if not len(nodes):
                continue
            rows = np.concatenate([rows_of[n] for n in nodes])
            if seen is not None:
                seen.append(len(rows))
            rows = rows[((labels[rows] == q_labels[i]) == same) & (ids[rows] != q_ids[i])]
            scores = (v[rows] @ q[i]).astype(np.int64)
            for w in range(len(wanted)):
                fit = (scores >= low[w]) & (scores <= high[w])
                if fit.any():
                    s, r = np.concatenate([best[w][0], scores[fit]]), np.concatenate([best[w][1], ids[rows[fit]]])
                    keep = np.lexsort((r, -s))[:k]
                    best[w] = (s[keep], r[keep])
                    if len(keep) == k:
                        low[w] = max(low[w], float(s[keep][-1]))
        for w, (s, r) in enumerate(best):
            out.extend((i, w, int(x), int(y)) for x, y in zip(r, s))
    return out


class Net:
    """Per width: pivots, squared radius of the sphere, covering angles and the sampled rows. Bounded by ``SAMPLE`` rows a table."""

    def __init__(self, sample: list, tops: dict[int, tuple[int, float]], shard_rows: int) -> None:
        self.top = {w: max(1.0, m) for w, (_, m) in tops.items()}
        self.rows, self.pivots, self.cosine = {}, {}, {}
        for width, (n, _) in tops.items():
            mine = [r for r in sample if r["width"] == width]
            v = np.array([r["v"] for r in mine], dtype=np.int64).reshape(len(mine), width)
            self.rows[width] = (v, np.array([r["vec_id"] for r in mine], dtype=np.int64), np.array([r["label"] for r in mine], dtype=object))
            points = augmented(v, self.top[width])
            picks = net(points, self.top[width], max(1, -(-n // shard_rows)), halve=False)[0] if len(mine) else []
            self.pivots[width] = points[picks]

    def place(self, width: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and cosine of the angle to its pivot; a width without sampled rows is one cell without bounds."""
        if not len(self.pivots[width]):
            return np.zeros(len(v), dtype=np.int64), np.full(len(v), -1.0)
        dots = augmented(v, self.top[width]) @ self.pivots[width].T
        cell = dots.argmax(axis=1)
        return cell, dots[np.arange(len(v)), cell] / self.top[width]

    def bounds(self, width: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.cosine[width]
        norms = np.sqrt(np.einsum("ij,ij->i", q.astype(float), q.astype(float)))
        if not len(self.pivots[width]):
            return np.full((len(q), 1), np.inf), np.full((len(q), 1), -np.inf)
        return bounds(q.astype(float) @ self.pivots[width][:, :-1].T, norms, self.top[width], cosine)

    def lifted(self, width: int, q, q_id, q_label, windows, k: int, same: bool) -> list[list[float]]:
        """Lower ends of the windows, lifted to the k-th best sampled score inside."""
        v, ids, labels = self.rows[width]
        scores = v.astype(float) @ q.astype(float).T
        out = []
        for i, wanted in enumerate(windows):
            fit = scores[:, i][((labels == q_label[i]) == same) & (ids != q_id[i])]
            lows = []
            for low, high in wanted:
                inside = fit[(fit >= low) & (fit <= high)]
                lows.append(float(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else float(low))
            out.append(lows)
        return out


def _windows(batch: pa.RecordBatch, same: bool) -> list[list[tuple[float, float]]]:
    if same:
        return [[(-np.inf, np.inf)]] * batch.num_rows
    return [[(float(w["low"]), float(w["high"])) for w in ws] for ws in batch.column("windows").to_pylist()]


def _routed(anchors: DataFrame, index: Net, k: int, same: bool) -> DataFrame:
    """``anchors`` with the cells to visit and, per window, the lifted lower end."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                widths = part.column("width").to_numpy()
                for width in np.unique(widths):
                    batch = part.filter(pa.array(widths == width))
                    q, windows = matrix(batch.column("v")), _windows(batch, same)
                    lows = index.lifted(width, q, batch.column("vec_id").to_numpy(), batch.column("label").to_pylist(), windows, k, same)
                    upper, lower = index.bounds(width, q)
                    cells = []
                    for i, wanted in enumerate(windows):
                        reach = np.zeros(upper.shape[1], dtype=bool)
                        for low, (_, high) in zip(lows[i], wanted):
                            reach |= (upper[i] >= low) & (lower[i] <= high)
                        cells.append(np.flatnonzero(reach).tolist())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.float64()))],
                                                     [*batch.schema.names, "cells", "lows"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"{kinds}, cells array<long>, lows array<double>")


def _search(shards: DataFrame, sizes: DataFrame, routed: DataFrame, index: Net, k: int, same: bool, block_anchors: int) -> DataFrame:
    """Best rows per (anchor, window) and shard."""
    sent = routed.withColumn("cell", F.explode("cells")).drop("cells")
    cell = ["width", "cell"]
    blocks = sent.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_anchors).alias("blocks"))
    plan = F.broadcast(sizes.join(blocks, cell).select(*cell, "subs", "blocks"))   # at most one row per cell, cells are bounded by the sample
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = [*cell, "sub", "block"]
    left = shards.join(plan, cell).withColumn("sub", F.pmod(F.xxhash64("vec_id", "label"), F.col("subs"))).withColumn("block", every("blocks"))
    right = sent.join(plan, cell).withColumn("block", F.pmod(F.xxhash64("vec_id", "uid"), F.col("blocks"))).withColumn("sub", every("subs"))
    left = spread(left.select(*key, "vec_id", "label", "v"), *key)
    right = spread(right.drop("subs", "blocks"), *key)
    top = index.top

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            rows, anchors = rows.combine_chunks(), anchors.combine_chunks()
            width = anchors.column("width")[0].as_py()
            whole = matrix(rows.column("v").chunk(0))
            q_whole = matrix(anchors.column("v").chunk(0))
            v, q = whole.astype(float), q_whole.astype(float)
            ids, labels = rows.column("vec_id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
            uid, q_ids, q_labels = anchors.column("uid").to_numpy(), anchors.column("vec_id").to_numpy(), anchors.column("label").to_pylist()
            highs = [[w[1] for w in ws] for ws in _windows(anchors.to_batches()[0], same)]
            windows = [list(zip(low, high)) for low, high in zip(anchors.column("lows").to_pylist(), highs)]
            best = descend(CoverTree(whole, top[width]), v, ids, labels, q, q_ids, q_labels, windows, k, same)
            found = [(int(q_ids[i]), int(uid[i]), w, r, s) for i, w, r, s in best]
        return pa.Table.from_pylist([dict(zip(("anchor_id", "uid", "item", "found_id", "score"), f)) for f in found], schema=pa.schema(
            [("anchor_id", pa.int64()), ("uid", pa.int64()), ("item", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())]))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, FOUND)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``vectors`` (vec_id, label, embedding).

    Anchors are the rows whose vec_id ``every`` divides, positives their best rows of the same label, negatives per positive the best rows of
    other labels that score between ``low`` and ``high`` hundredths of the positive's score.
    """
    spark, scratch, e = vectors.sparkSession, Scratch(vectors.sparkSession), F.col("embedding")
    rows = vectors.where(finite(e) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(e, scale, 1 << 26).alias("v"))
    order = F.dense_rank().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    chosen = rows.withColumn("nth", order).where(F.col("nth") <= max(positives + 1, negatives)).dropDuplicates(["label", "v", "vec_id"]).drop("nth")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = scratch.write(chosen.withColumn("width", F.size("v")), "negatives-candidates")
    tops = {r["width"]: (r["n"], r["m"]) for r in kept.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("m")).collect()}
    if not tops:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if max(m for _, m in tops.values()) >= 2.0 ** 52:
        raise ValueError("a vector has a norm of 2**26 or more after scaling")
    index = Net(kept.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "v").limit(sample).collect(), tops, shard_rows)

    def place(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                cell, cosine = index.place(width, matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(cosine)], [*part.schema.names, "cell", "cosine"])

    shards = scratch.write(kept.mapInArrow(place, "vec_id long, label string, v array<int>, width int, cell long, cosine double"), "negatives-cells")
    scratch.drop("negatives-candidates")
    sizes = shards.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("subs"), F.min("cosine").alias("cosine"))
    counted = sizes.collect()   # one row per cell
    measured = {(r["width"], r["cell"]): r["cosine"] for r in counted}
    sizes = spark.createDataFrame([(r["width"], r["cell"], r["subs"]) for r in counted], "width int, cell long, subs long")
    for width, pivots in index.pivots.items():     # an empty cell covers nothing but its pivot
        index.cosine[width] = np.array([measured.get((width, i), 1.0) for i in range(max(1, len(pivots)))])

    anchors = (rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
               .withColumn("width", F.size("v")).withColumn("uid", F.xxhash64("label", "v")))
    anchors = scratch.write(anchors, "negatives-anchors")
    routed = scratch.write(_routed(anchors, index, positives, True), "negatives-routed")
    near = _search(shards, sizes, routed, index, positives, True, block_anchors)
    first = top_per_group(near, ["anchor_id", "uid"], [F.desc("score"), F.col("found_id"), F.col("item")], positives)
    wanted = F.struct(F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
                      F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("low"),
                      F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("high"))
    best = first.groupBy("anchor_id", "uid").agg(F.sort_array(F.collect_list(wanted)).alias("windows"))   # at most ``positives`` each
    best = best.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"])).where(F.size("windows") > 0)
    asked = scratch.write(anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "uid"]).select(*anchors.columns, "windows"), "negatives-windows")
    scratch.drop("negatives-routed", "negatives-anchors")
    routed = scratch.write(_routed(asked, index, negatives, False), "negatives-asked")
    hard = scratch.write(top_per_group(_search(shards, sizes, routed, index, negatives, False, block_anchors), ["anchor_id", "uid", "item"],
                                       [F.desc("score"), F.col("found_id")], negatives), "negatives-found")
    named = asked.select(F.col("vec_id").alias("anchor_id"), "uid", F.posexplode("windows").alias("item", "w")).select("anchor_id", "uid", "item", "w.*")
    return named.join(hard, ["anchor_id", "uid", "item"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
