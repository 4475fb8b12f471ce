"""Cosine similarity search and long-sequence alignment over vector tables."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from narralytics.functions import kernels
from narralytics.operators.ranking import exact_percentiles, top_per_group
from narralytics.session import Scratch, cut_lineage, spread, stored

BROADCAST_BYTES = 64 << 20  # a right side up to this size goes to every task
BLOCK_BYTES = 32 << 20      # else each side is cut into blocks of this size
SAMPLE = 4096               # right vectors that pivots are taken from
SLACK = 1e-9                # room for rounding in bounds of similarities
ROUNDING = 2e-12            # similarities are compared to twelve digits
TILE = 1024                 # left rows and
TILE_COLUMNS = 4096         # right rows that are multiplied at once in a task


def _merged(known: tuple, row: np.ndarray, col: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of the (row, col, key, score) known so far and the new ones, per row; equal keys go to the smaller column."""
    row, col, key, score = (np.concatenate(both) for both in zip(known, (row, col, key, score)))
    order = np.lexsort((col, -key, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    order = order[place < k]
    return row[order], col[order], key[order], score[order]


def _top_frame(left_ids: pd.Series, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray, k: int) -> pd.DataFrame:
    """The k best right rows of every left row; equal scores go to the smaller id.

    Scores are made in tiles of ``TILE`` rows and ``TILE_COLUMNS`` columns, so memory does not grow with either side. From the second tile
    of a row on, only scores that reach the k-th best so far are looked at.
    """
    by_id = np.argsort(right_ids, kind="stable")
    if (by_id[1:] < by_id[:-1]).any():
        right_ids, right = right_ids[by_id], right[by_id]
    unit, found = kernels.unit_rows(left), []
    for top in range(0, len(unit), TILE):
        some = unit[top:top + TILE]
        kth = np.full(len(some), -np.inf)
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
        for start in range(0, len(right), TILE_COLUMNS):
            scores = some @ right[start:start + TILE_COLUMNS].T
            keys = np.where(np.isnan(scores), -np.inf, scores)    # undefined similarities come last
            reach = kth
            if start == 0 and keys.shape[1] > k:
                reach = np.partition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k]
            row, col = np.nonzero(keys >= (reach - ROUNDING)[:, None])
            best = _merged(best, row, col + start, np.round(keys[row, col], 12), scores[row, col], k)
            last = np.searchsorted(best[0], np.arange(len(some)), side="right") - 1
            full = np.bincount(best[0], minlength=len(some)) >= k
            kth[full] = best[2][last[full]]
        found.append((best[0] + top, best[1], best[3]))
    row, col, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    return pd.DataFrame({"left_id": left_ids.to_numpy()[row], "right_id": right_ids[col], "similarity": score})


def _farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the one farthest in angle from those before; ends when only copies are left."""
    picks, best = [0], points @ points[0]
    while len(picks) < count and best.min() < 1 - 1e-12:
        picks.append(int(best.argmin()))
        best = np.maximum(best, points @ points[picks[-1]])
    return points[picks]


class AngularCells:
    """Cells of unit vectors around sampled pivots, with the angle each cell covers.

    The last cell is for zero vectors: their similarity is 0 to everything.
    """

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.rows = np.zeros(len(pivots) + 1, dtype=np.int64)
        self.cosine = np.ones(len(pivots))

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every row and the cosine to its pivot."""
        zero = ~unit.any(axis=1)
        if not len(self.pivots):
            return np.zeros(len(unit), dtype=np.int64), np.ones(len(unit))
        dots = unit @ self.pivots.T
        cell = dots.argmax(axis=1)
        return np.where(zero, len(self.pivots), cell), np.where(zero, 1.0, dots[np.arange(len(unit)), cell])

    def measured(self, sizes: Iterable) -> None:
        for cell, rows, cosine in sizes:
            self.rows[cell] = rows
            if cell < len(self.pivots):
                self.cosine[cell] = cosine - SLACK

    def upper(self, unit: np.ndarray) -> np.ndarray:
        """The largest similarity any row of a cell can have, per (row, cell); -inf for empty cells."""
        dots = np.clip(unit @ self.pivots.T, -1.0, 1.0)
        reach = dots * self.cosine + np.sqrt(1 - dots * dots) * np.sqrt(np.maximum(1 - self.cosine * self.cosine, 0.0))
        bound = np.where(dots >= self.cosine, 1.0, reach) + SLACK
        bound[~unit.any(axis=1)] = SLACK
        bound = np.column_stack([bound, np.full(len(unit), SLACK)])
        bound[:, self.rows == 0] = -np.inf
        return bound

    def nearest(self, unit: np.ndarray, k: int) -> np.ndarray:
        """Per row the cells of highest bound that together hold ``k`` rows, as a mask."""
        bound = self.upper(unit)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mask = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(mask, order, before < k, axis=1)
        return mask & (bound > -np.inf)


def _cells(right: DataFrame, count: int, block_vectors: int) -> AngularCells:
    filled = right.select("id", "vec").where(F.exists("vec", lambda x: x != 0))
    sample = filled.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return AngularCells(np.zeros((0, right.select(F.max(F.size("vec"))).first()[0])))
    unit = kernels.unit_rows(np.stack(sample["vec"].to_numpy()).astype(float))
    return AngularCells(_farthest_first(unit, -(-count // block_vectors)))


def _pruned_top_k(left: DataFrame, right: DataFrame, k: int, count: int, block_vectors: int, report: dict | None) -> DataFrame:
    """The large way of ``cosine_top_k``: blocks that cannot hold any of a vector's k best are not visited."""
    scratch = Scratch(left.sparkSession)
    cells = _cells(right, count, block_vectors)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, cosine = cells.place(kernels.unit_rows(np.stack(pdf["vec"].to_numpy()).astype(float)))
                yield pdf.assign(cell=cell, cosine=cosine)

    placed = scratch.write(right.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(
        place, "id long, vec array<double>, cell long, cosine double"), "top-k-cells")
    # at most one row per cell; the cells are bounded by the sample
    cells.measured((r["cell"], r["n"], r["cosine"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine")).collect())
    subs = left.sparkSession.createDataFrame([(i, int(-(-n // block_vectors))) for i, n in enumerate(cells.rows) if n], "cell long, subs long")

    def routed(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (id, vec, kth) with the cells to visit: the nearest ones first, then those that can still hold a better row."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), 512):
                    pdf = whole.iloc[start:start + 512]
                    unit = kernels.unit_rows(np.stack(pdf["vec"].to_numpy()).astype(float))
                    mask = cells.nearest(unit, k)
                    if name != "near":
                        mask = ~mask & (cells.upper(unit) >= pdf["kth"].to_numpy()[:, None])
                    yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "cells": [np.flatnonzero(m) for m in mask]})

        return scratch.write(rows.select("id", F.col("vec").cast("array<double>").alias("vec"), "kth").mapInPandas(
            run, "id long, vec array<double>, cells array<long>"), f"top-k-{name}")

    def met(sent: DataFrame, name: str) -> DataFrame:
        each = sent.withColumn("cell", F.explode("cells")).drop("cells")
        visits = each.groupBy("cell").agg(F.count("*").alias("n"))
        if report is not None:
            report["visited"] = report.get("visited", 0) + (visits.agg(F.sum("n")).first()[0] or 0)
        plan = F.broadcast(subs.join(visits, "cell").select("cell", "subs", F.ceil(F.col("n") / block_vectors).alias("parts")))  # one row per cell
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        key = ["cell", "sub", "part"]
        l = each.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("sub", every("subs"))
        r = placed.join(plan, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs"))).withColumn("part", every("parts"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})
            other = kernels.unit_rows(np.stack(b["vec"].to_numpy()).astype(float))
            return _top_frame(a["id"], np.stack(a["vec"].to_numpy()).astype(float), b["id"].to_numpy(), other, k)

        found = spread(l.select(*key, "id", "vec"), *key).groupBy(*key).cogroup(spread(r.select(*key, "id", "vec"), *key).groupBy(*key)).applyInPandas(
            meet, "left_id long, right_id long, similarity double")
        return scratch.write(_k_best(found, k).drop("rank"), f"top-k-found-{name}")

    unknown = left.select("id", "vec", F.lit(None).cast("double").alias("kth"))
    first = met(routed(unknown, "near"), "near")
    scratch.drop("top-k-near")
    kth = first.groupBy("left_id").agg(F.min("similarity").alias("kth"), F.count("*").alias("n"))
    known = left.select("id", "vec").join(kth.withColumnRenamed("left_id", "id"), "id", "left").select(
        "id", "vec", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("kth"))
    second = met(routed(known, "rest"), "rest")
    if report is not None:
        report |= {"pairs": left.count() * int((cells.rows > 0).sum()), "cells": int((cells.rows > 0).sum())}
    best = stored(_k_best(first.unionByName(second), k), "top-k")
    scratch.clear()
    return best


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best per left row; similarities that differ by rounding only count as equal."""
    return top_per_group(found, ["left_id"], [F.round("similarity", 12).desc(), F.col("right_id")], k)


def cosine_top_k(left: DataFrame, right: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES,
                 block_bytes: int = BLOCK_BYTES, report: dict | None = None) -> DataFrame:
    """(left_id, right_id, similarity, rank): the k most similar right vectors of every left vector.

    Both inputs are (id long, vec array) with unique left ids. A right side within the limit in bytes is sent to every task.
    A larger one is dealt to cells around pivots, farthest first from ``SAMPLE`` rows in hash order, and Spark measures the angle each
    cell covers. A left vector first meets the cells of highest bound that hold k rows; its k-th best similarity
    there is a lower bound, so only cells whose bound reaches it are visited after that. Cells are cut into blocks of ``block_bytes``
    and met in bounded tasks which keep their k best. Both ways give the same rows. Zero vectors have similarity 0.
    ``report`` is filled with the number of cells, of (left vector, cell) ``pairs`` and of those ``visited``.
    """
    schema = "left_id long, right_id long, similarity double"
    count, width = right.agg(F.count("*"), F.max(F.size("vec"))).first()
    row_bytes = 8 * ((width or 0) + 1)
    if count * row_bytes > broadcast_bytes:
        return _pruned_top_k(left, right, k, count, max(1, block_bytes // row_bytes), report)
    head = right.select("id", "vec").toPandas()
    ids = head["id"].to_numpy(dtype=np.int64)
    matrix = kernels.unit_rows(np.stack(head["vec"].to_numpy()).astype(float) if count else np.zeros((0, 1)))
    shared = left.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right_ids, right_matrix = shared.value
        for pdf in batches:
            if len(pdf) and len(right_ids):
                yield _top_frame(pdf["id"], np.stack(pdf["vec"].to_numpy()).astype(float), right_ids, right_matrix, k)

    return _k_best(left.select("id", "vec").mapInPandas(scan, schema), k)


def nearest_distance(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Cosine distance, clipped to [0, 2], from every left vector to its nearest right vector."""
    distance = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - F.col("similarity")))
    return cosine_top_k(left, right, 1, **options).select("left_id", distance.alias("distance"))


def nearest_neighbour_stats(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    distances = cut_lineage(nearest_distance(left, right, **options))
    tails = exact_percentiles(distances, "distance", [0.5, 0.95]).first()
    return distances.agg(F.avg("distance").alias("mean")).withColumn("median", F.lit(tails["p0"])).withColumn("p95", F.lit(tails["p1"]))


# --- alignment of two long vector sequences ---------------------------------------------------

_EDGE = StructType([StructField(n, ArrayType(DoubleType() if "cost" in n else IntegerType()))
                    for n in ("bottom_cost", "bottom_length", "right_cost", "right_length")])


def _fill_block(cost: np.ndarray, top: tuple, left: tuple, corner: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Costs and path lengths of one block from its three borders; ties prefer up, left, diagonal."""
    n, m = cost.shape
    c, s = np.full((n + 1, m + 1), np.inf), np.zeros((n + 1, m + 1), dtype=np.int64)
    c[0, 0], s[0, 0] = corner
    c[0, 1:], s[0, 1:] = top
    c[1:, 0], s[1:, 0] = left
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        options = np.stack([c[i - 1, j], c[i, j - 1], c[i - 1, j - 1]])
        lengths = np.stack([s[i - 1, j], s[i, j - 1], s[i - 1, j - 1]])
        pick = options.argmin(axis=0)
        c[i, j] = options[pick, np.arange(len(i))] + cost[i - 1, j - 1]
        s[i, j] = lengths[pick, np.arange(len(i))] + 1
    return c, s


@F.pandas_udf(_EDGE)
def _align_block(a: pd.Series, b: pd.Series, top_cost: pd.Series, top_length: pd.Series, left_cost: pd.Series,
                 left_length: pd.Series, corner_cost: pd.Series, corner_length: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y, tc, tl, lc, ll, cc, cl in zip(a, b, top_cost, top_length, left_cost, left_length, corner_cost, corner_length):
        x, y = kernels.unit_rows(np.stack(x).astype(float)), kernels.unit_rows(np.stack(y).astype(float))
        cost = np.clip(1.0 - x @ y.T, 0.0, 2.0)
        n, m = cost.shape
        top = (np.full(m, np.inf), np.zeros(m)) if tc is None else (tc, tl)
        left = (np.full(n, np.inf), np.zeros(n)) if lc is None else (lc, ll)
        c, s = _fill_block(cost, top, left, (cc, cl))
        rows.append((c[-1, 1:].tolist(), s[-1, 1:].tolist(), c[1:, -1].tolist(), s[1:, -1].tolist()))
    return pd.DataFrame(rows, columns=[f.name for f in _EDGE.fields])


def _sequence_blocks(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    packed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda e: e["vec"])
    return df.withColumn("block", F.floor(F.col("pos") / size).cast("int")).groupBy(*keys, "block").agg(packed.alias("vecs"))


def align_sequences(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("pair",), block: int = 1024) -> DataFrame:
    """Dynamic-time-warping of two vector sequences per pair, of any length.

    Inputs are (keys, pos from 0, vec). The cost grid is cut into blocks and solved one anti-diagonal
    of blocks at a time: blocks of a wave run in parallel and hand on only their borders, which are
    written; a wave is deleted when the second after it stands. Waves are as many as the longest pair has blocks on both
    sides. Returns the raw, the (n + m)-normalised and the path-normalised distance.
    """
    keys, scratch = list(keys), Scratch(left.sparkSession)
    l = scratch.write(_sequence_blocks(left, keys, block), "align-left")
    r = scratch.write(_sequence_blocks(right, keys, block), "align-right")
    shape = lambda df, n, b: df.groupBy(*keys).agg(F.sum(F.size("vecs")).alias(n), F.count("*").cast("int").alias(b))
    sizes = scratch.write(shape(l, "n", "lb").join(shape(r, "m", "rb"), keys), "align-sizes")
    ends = {w[0] for w in sizes.select(F.col("lb") + F.col("rb") - 2).distinct().collect()}    # waves in which a pair is finished
    if not ends:
        raise ValueError("no pair has both sequences")
    last = max(ends) + 2
    l, r = l.withColumnsRenamed({"block": "bi", "vecs": "a"}), r.withColumnsRenamed({"block": "bj", "vecs": "b"})
    done: list[DataFrame] = []
    results = []
    for wave in range(last - 1):
        low, high = F.greatest(F.lit(0), F.lit(wave + 1) - F.col("rb")), F.least(F.lit(wave), F.col("lb") - 1)
        cells = sizes.where(low <= high).withColumn("bi", F.explode(F.sequence(low, high))).withColumn("bj", F.lit(wave) - F.col("bi"))
        work = cells.join(l, [*keys, "bi"]).join(r, [*keys, "bj"])
        origin = (F.col("bi") == 0) & (F.col("bj") == 0)
        if wave == 0:
            none_d, none_i = F.lit(None).cast("array<double>"), F.lit(None).cast("array<int>")
            work = work.select("*", none_d.alias("tc"), none_i.alias("tl"), none_d.alias("lc"), none_i.alias("ll"),
                               F.lit(0.0).alias("cc"), F.lit(0).alias("cl"))
        else:
            before = done[-1]
            above = before.select(*keys, (F.col("bi") + 1).alias("bi"), "bj", F.col("e.bottom_cost").alias("tc"), F.col("e.bottom_length").alias("tl"))
            beside = before.select(*keys, "bi", (F.col("bj") + 1).alias("bj"), F.col("e.right_cost").alias("lc"), F.col("e.right_length").alias("ll"))
            work = work.join(above, [*keys, "bi", "bj"], "left").join(beside, [*keys, "bi", "bj"], "left")
            if wave > 1:
                across = done[-2].select(*keys, (F.col("bi") + 1).alias("bi"), (F.col("bj") + 1).alias("bj"),
                                         F.element_at("e.bottom_cost", -1).alias("cc"), F.element_at("e.bottom_length", -1).alias("cl"))
                work = work.join(across, [*keys, "bi", "bj"], "left")
            else:
                work = work.withColumn("cc", F.lit(None).cast("double")).withColumn("cl", F.lit(None).cast("int"))
            work = work.withColumn("cc", F.coalesce("cc", F.when(origin, 0.0).otherwise(float("inf")))).withColumn("cl", F.coalesce("cl", F.lit(0)))
        solved = scratch.write(work.select(*keys, "n", "m", "lb", "rb", "bi", "bj", _align_block("a", "b", "tc", "tl", "lc", "ll", "cc", "cl").alias("e")), f"wave-{wave}")
        done = [*done[-1:], solved]
        if wave in ends:
            results.append(stored(solved.where((F.col("bi") == F.col("lb") - 1) & (F.col("bj") == F.col("rb") - 1)), "aligned"))
        if wave > 1:
            scratch.drop(f"wave-{wave - 2}")
    scratch.clear()
    corner = results[0]
    for extra in results[1:]:
        corner = corner.unionByName(extra)
    raw, length = F.element_at("e.bottom_cost", -1), F.element_at("e.bottom_length", -1)
    return corner.select(*keys, raw.alias("dtw_distance"), (raw / (F.col("n") + F.col("m"))).alias("normalized_dtw_distance"),
                         (raw / length).alias("path_normalized_dtw_distance"), length.alias("dtw_path_length"))
