"""Near-duplicate vectors by cross-polytope hashing.

A vector is padded to a power of two, turned by three rounds of random signs and a fast Hadamard
transform, and hashed to the axis (with sign) it points along most; ``AXES`` such hashes form the key of one
table. Each vector is stored under its own key and also sent to the keys that its next best axes give
(multiprobe). Rows meet by (label, width, table, key); a meeting of more than ``TILE_ROWS`` rows is cut
into tiles whose pairs of blocks go to different tasks, so no partner is dropped. Every candidate is
verified by its cosine in double precision, and a pair that meets several times is counted at its first
meeting only. A task returns, per vector, a link count and one neighbour label, never the pairs.

Defined results: a row with a null vec_id, null label, or a vector that is null, empty, zero or holds null or
non-finite components links with nothing (n_links 0, component_id = vec_id). Equal vectors of one label are
one class while searching; every copy counts in n_links. Rows of one vec_id with other vectors are vectors each. Widths never mix. An empty table gives an empty
result; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from narralytics.llm.common import written
from narralytics.llm.graph import components, local_labels
from narralytics.session import spread

THRESHOLD = 0.93
TABLES = 6
AXES = 2         # hashes per key: (2 * width) ** AXES keys per label and table; one more for every 100 times as many rows
PROBES = 2       # further keys per vector and table
ROWS_PER_AXES = 10_000_000   # vectors of one label that AXES and TABLES are made for
TILE_ROWS = 1024
SEED = 7
FOLD = (1 << 31) - 1


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform of the padded rows."""
    width = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out = out * rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = out.reshape(len(x), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
    return out


def keys(x: np.ndarray, tables: int = TABLES, axes: int = AXES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) keys; the first of each table is the home key. Keys that leave 31 bits are folded, which only adds candidates."""
    out = np.empty((len(x), tables, 1 + probes), dtype=np.int32)
    for t in range(tables):
        first, second, loss = [], [], []
        for a in range(axes):
            y = rotate(x, SEED + 1000 * t + a)
            width = y.shape[1]
            order = np.argsort(-np.abs(y), axis=1)[:, :probes + 1]
            rows = np.arange(len(x))[:, None]
            picked = order * 2 + (y[rows, order] < 0)
            strength = np.abs(y[rows, order])
            scale = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            first.append(picked[:, 0]), second.append(picked[:, 1:])
            loss.append((strength[:, :1] - strength[:, 1:]) / scale)
            base = 2 * width
        home = sum(first[a] * base ** a for a in range(axes))
        other = np.concatenate([home[:, None] + (second[a] - first[a][:, None]) * base ** a for a in range(axes)], axis=1)
        best = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = home % FOLD
        out[:, t, 1:] = np.take_along_axis(other, best, axis=1) % FOLD
    return out


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of an Arrow list column of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct (label, vector): smallest vec_id, hash, number of copies, label, width, vector."""
    return (rows.groupBy("label", "vector").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies"))
            .select("cls", F.xxhash64("label", "vector").alias("uid"), "copies", "label", F.size("vector").alias("width"), "vector"))


def _hashed(classes: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """Adds ``codes``: the flattened keys of all tables."""
    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                codes = keys(matrix(part.column("vector")).astype(float), tables, axes, probes).reshape(part.num_rows, -1)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], [*part.schema.names, "codes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", codes array<int>"
    return classes.mapInArrow(run, schema)


def _verified(home_of, codes, i, j, table, key, tables, probes) -> np.ndarray:
    """Which pairs (i, j) are met first in this table under this key."""
    ci, cj = codes[i].reshape(-1, tables, 1 + probes), codes[j].reshape(-1, tables, 1 + probes)
    same = ci[:, :, 0] == cj[:, :, 0]
    i_to_j = (ci[:, :, :1] == cj).any(axis=2)   # j is sent to the home of i
    j_to_i = (cj[:, :, :1] == ci).any(axis=2)
    met = same | i_to_j | j_to_i
    where = np.argmax(met, axis=1)              # first table with a meeting
    r = np.arange(len(i))
    hi, hj = ci[r, where, 0], cj[r, where, 0]
    at = np.where(i_to_j[r, where] & j_to_i[r, where], np.minimum(hi, hj), np.where(i_to_j[r, where], hi, hj))
    return (where == table) & (at == key)


def _cell_links(uid, copies, vectors, codes, home, block, cell, table, key, threshold, tables, probes):
    """Link counts and labels of one tile; pairs of one block are compared only in its own tile."""
    norm = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    n, left, right = len(uid), [], []
    for start in range(0, n, 256):
        close = norm[start:start + 256] @ norm.T >= threshold
        i, j = np.nonzero(close)
        i = i + start
        keep = (i < j) & (home[i] | home[j])
        if cell[0] != cell[1]:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        if len(i):
            first = _verified(home, codes, i, j, table, key, tables, probes)
            left.append(i[first]), right.append(j[first])
    i, j = (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))
    count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    label = local_labels(i, j, n)
    linked = np.flatnonzero(count > 0)
    return uid[linked], count[linked].astype(np.int64), uid[label[linked]]


def class_links(hashed: DataFrame, threshold: float, tables: int, probes: int, tile_rows: int) -> DataFrame:
    """(uid, links, peer): per tile and class, the copies it links to and a class it is connected with."""
    per = 1 + probes
    meeting = ["label", "width", "tab", "key"]
    sent = hashed.select("uid", "label", "width", F.posexplode("codes").alias("slot", "key")).select(
        "uid", "label", "width", (F.col("slot") / per).cast("int").alias("tab"), "key", (F.col("slot") % per == 0).alias("home"))
    sizes = (sent.groupBy(*meeting).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
             .where("homes > 0 AND n > 1").select(*meeting, F.ceil(F.col("n") / tile_rows).alias("blocks")))
    placed = sent.join(sizes, meeting).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(
        F.least(b, F.col("block")).alias("lo"), F.greatest(b, F.col("block")).alias("hi")))
    tiles = placed.withColumn("cell", F.explode(cells)).select("uid", "tab", "key", "home", "block", "cell.lo", "cell.hi")
    tiled = tiles.join(hashed.drop("cls"), "uid")   # vectors join last, so only meeting rows carry them
    order = [*meeting, "lo", "hi"]
    sorted_tiles = spread(tiled, *order).sortWithinPartitions(*order)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            get = lambda c: rows.column(c).to_numpy()
            label, tab, key, lo, hi, width = (get(c) for c in ("label", "tab", "key", "lo", "hi", "width"))
            change = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) \
                | (label[1:] != label[:-1]) | (width[1:] != width[:-1])
            edges = [0, *(np.flatnonzero(change) + 1), len(tab)]
            uid, copies, home, block = get("uid"), get("copies").astype(float), get("home"), get("block")
            out = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    part = rows.slice(a, b - a).combine_chunks()
                    vectors = matrix(part.column("vector").chunk(0)).astype(float)
                    codes = matrix(part.column("codes").chunk(0))
                    out.append(_cell_links(uid[a:b], copies[a:b], vectors, codes, home[a:b], block[a:b],
                                           (lo[a], hi[a]), tab[a], key[a], threshold, tables, probes))
            if out:
                c, n, p = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), pa.array(p)], ["uid", "links", "peer"])

        def last_start(batch: pa.RecordBatch) -> int:
            """Where the last tile of the batch begins."""
            values = [batch.column(c).to_pylist() for c in order]
            at = batch.num_rows - 1
            while at and all(v[at - 1] == v[-1] for v in values):
                at -= 1
            return at

        for batch in batches:
            if not batch.num_rows:
                continue
            cut = last_start(batch)
            if held and any(batch.column(c)[0] != held[0].column(c)[0] for c in order):
                yield from done(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return sorted_tiles.mapInArrow(run, "uid long, links long, peer long")


def key_shape(rows: int) -> tuple[int, int]:
    """(axes, tables) for so many vectors of one label.

    A further axis makes keys some hundred times as many and a meeting in one table less likely, which twice the tables make good: the recall measured for pairs
    exactly at the threshold, width 64, is 0.999 with 2 axes and 6 tables, 0.997 with 3 and 12, 0.998 with 4 and 24.
    """
    extra, size = 0, rows
    while size > ROWS_PER_AXES:
        extra, size = extra + 1, size / 100
    return AXES + extra, TABLES * 2 ** extra


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, axes: int | None = None,
                    probes: int = PROBES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label).

    Axes and tables follow from the vectors of the largest label unless they are given.
    """
    # single-precision vectors travel as they are; all arithmetic is in double precision
    kept = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                          F.col("embedding").cast(kept).alias("vector"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False))
    keyed = rows.withColumn("ok", ok).withColumn("vector", F.when(F.col("ok"), F.transform("vector", lambda v: F.when(v == 0, F.lit(0).cast(kept[6:-1])).otherwise(v))))
    classes = _classes(keyed.where("ok"))
    if axes is None or tables is None:
        most = classes.groupBy("label").agg(F.sum("copies").alias("n")).agg(F.max("n")).first()[0] or 0
        axes, tables = key_shape(most)
    hashed = written(_hashed(classes, tables, axes, probes), "vector-classes")
    met = written(class_links(hashed, threshold, tables, probes, tile_rows), "vector-links")
    found = components(met.select(F.col("uid").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "uid")
    counts = met.groupBy("uid").agg(F.sum("links").alias("links"))
    rooted = hashed.select("uid", "cls", "copies", "label", "vector").join(found, "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    low = found.join(hashed.select("uid", "cls"), "uid").groupBy("component").agg(F.min("cls").alias("low")).withColumnRenamed("component", "root")
    named = (rooted.join(counts, "uid", "left").join(low, "root", "left")
             .select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "cls").alias("component_id")))
    linked = keyed.where("ok").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
