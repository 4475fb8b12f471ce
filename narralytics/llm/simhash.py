"""Near-duplicate documents by SimHash fingerprints, searched with vantage-point trees.

Distinct fingerprints are first dealt to forced partitions: of ``radius + 1`` blocks of bits, two fingerprints within the radius have one block
equal, so every fingerprint travels once per block, to the bucket of (block, some bits of it); the bits grow with the table, so buckets stay near
``BUCKET_SHARDS`` shards. A bucket that is still far larger is keyed by all bits of its block. Inside a bucket a vantage-point tree
splits by Hamming distance: at every node, a fingerprint of the inner side within the search radius of the boundary is also shown to the
outer side, so every pair within the radius meets in the leaf of one of the two (triangle inequality). Leaves are searched exactly. Buckets that
even a whole block leaves too large are dealt to the shards of a tree built from a sample: a fingerprint has one home shard and travels as a guest wherever
its ball reaches. A fingerprint thus travels ``radius + 1`` times at any table size, plus as a guest in the last case only.

Defined results: null and blank texts have fingerprint zero and link like any other; copies share a
fingerprint and count once in the search; a null doc_id takes part but never names a component (a
component of null ids only has a null component_id); an empty table gives an empty result; further
columns of the input are ignored. Several rows of one doc_id are rows each.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import utf8, written
from narralytics.llm.graph import components, local_labels
from narralytics.session import spread

RADIUS = 2
WORDS = 3
SEED = 42
SHARD_ROWS = 1024        # distinct fingerprints a shard should hold
BUCKET_SHARDS = 4        # shards of fingerprints a forced partition should hold
OVERSIZE = 16            # a bucket this many times as large is split further
MAX_SHARDS = 65536       # size of the tree that is sent to the tasks
SAMPLE_PER_SHARD = 16    # the tree is built from so many sampled fingerprints per shard
LEAF_PAIRS = 1 << 20     # pairs compared at once inside a task
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one UTF-8 text as an unsigned number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    starts = np.arange(0, len(hashes), 255)  # a byte lane counts to 255
    bits = np.zeros(64, dtype=np.int64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, starts)
        bits[b::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the ``kept`` long columns of every row; fp is the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64)), *[batch.column(c) for c in kept]], ["doc_id", "fp", *kept])

    kinds = "".join(f", {c} long" for c in kept)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *kept).mapInArrow(run, f"doc_id long, fp long{kinds}")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, leaf_rows: int = SAMPLE_PER_SHARD, radius: int = RADIUS):
    """Arrays (vantage, boundary, inner, outer); a negative child is a leaf, -1 - its number."""
    vantage, boundary, inner, outer, leaves = [], [], [], [], 0
    rng = np.random.default_rng(SEED)

    def best_split(points):
        best = None
        for v in points[rng.permutation(len(points))[:8]]:
            d = _distance(points, v)
            for mu in np.unique(np.quantile(d, [0.35, 0.5, 0.65]).astype(int)):
                share = np.mean(d <= mu)
                if 0.05 < share < 0.95:
                    cost = np.mean((d > mu - radius) & (d <= mu + radius)) + abs(share - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, int(mu), d <= mu)
        return best

    def grow(points) -> int:
        nonlocal leaves
        split = best_split(points) if len(points) > leaf_rows else None
        if split is None:
            leaves += 1
            return -leaves
        _, v, mu, near = split
        me = len(vantage)
        vantage.append(v), boundary.append(mu), inner.append(0), outer.append(0)
        inner[me], outer[me] = grow(points[near]), grow(points[~near])
        return me

    root = grow(sample)
    return root, np.array(vantage, np.uint64), np.array(boundary, np.int16), np.array(inner, np.int64), np.array(outer, np.int64)


def route(points: np.ndarray, tree, radius: int = RADIUS):
    """(row, leaf, guest) of every shard each fingerprint has to visit."""
    root, vantage, boundary, inner, outer = tree
    row, node, guest = np.arange(len(points)), np.full(len(points), root), np.zeros(len(points), bool)
    done = []
    while len(row):
        at_leaf = node < 0
        done.append((row[at_leaf], -1 - node[at_leaf], guest[at_leaf]))
        row, node, guest = row[~at_leaf], node[~at_leaf], guest[~at_leaf]
        d, mu = _distance(points[row], vantage[node]), boundary[node]
        inside = d <= mu
        go_in = np.where(guest, d <= mu + radius, inside)
        go_out = np.where(guest, d > mu - radius, ~inside)
        visit = ~guest & inside & (d > mu - radius)  # an inner point shown to the outer side
        row, node, guest = (np.concatenate([row[go_in], row[go_out], row[visit]]),
                            np.concatenate([inner[node[go_in]], outer[node[go_out]], outer[node[visit]]]),
                            np.concatenate([guest[go_in], guest[go_out], np.ones(visit.sum(), bool)]))
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (row, node, guest)


def close_pairs(home: np.ndarray, guest: np.ndarray, radius: int = RADIUS, depth: int = 0):
    """Index pairs (home, home) and (home, guest) within the radius; guests are numbered after the homes.

    A shard that came out large is split by the same rule until the rest can be compared outright.
    """
    found = []
    points = np.concatenate([home, guest])

    def search(h, g, level):
        if len(h) * (len(h) + len(g)) > LEAF_PAIRS and level < 64:
            rng = np.random.default_rng(level)
            for v in points[h[rng.integers(0, len(h), 4)]]:
                d, dg = _distance(points[h], v), _distance(points[g], v)
                mu = int(np.median(d))
                mu = mu if (d > mu).any() else mu - 1
                near = d <= mu
                if near.any() and not near.all():
                    search(h[near], g[dg <= mu + radius], level + 1)
                    search(h[~near], np.concatenate([g[dg > mu - radius], h[near & (d > mu - radius)]]), level + 1)
                    return
        others = np.concatenate([h, g])
        step = max(1, LEAF_PAIRS // max(1, len(others)))
        for start in range(0, len(h), step):
            i, j = np.nonzero(_distance(points[h[start:start + step], None], points[others][None, :]) <= radius)
            keep = h[start + i] != others[j]
            found.append((h[start + i][keep], others[j][keep]))

    search(np.arange(len(home)), np.arange(len(home), len(points)), depth)
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*found))


def bit_blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(shift, width) of the ``radius + 1`` blocks of a fingerprint."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def partitioned(fingerprints: DataFrame, total: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(block, key, leaf, fp, guest): every fingerprint in the bucket of each block, at home or as a guest."""
    blocks = bit_blocks(radius)
    goal = shard_rows * BUCKET_SHARDS
    bits = min(min(w for _, w in blocks), max(0, -(-total // goal) - 1).bit_length())
    value = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
    each = [F.struct(F.lit(i).alias("block"), value(s, w).alias("value")) for i, (s, w) in enumerate(blocks if bits else blocks[:1])]
    sent = fingerprints.select("fp", F.explode(F.array(*each)).alias("e")).select("fp", "e.*").withColumn(
        "low", F.col("value").bitwiseAND(F.lit((1 << bits) - 1)))
    if not bits:        # one bucket holds all
        return sent.select("block", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("leaf"), "fp", F.lit(False).alias("guest"))
    limit = goal * OVERSIZE
    crowded = sent.groupBy("block", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("block", "low", F.lit(True).alias("crowded"))
    crowded = written(crowded, "crowded-buckets")
    keyed = sent.join(crowded, ["block", "low"], "left")
    # all bits of the block are told from some of them by the sign
    keyed = keyed.select("block", F.when(F.col("crowded"), -1 - F.col("value")).otherwise(F.col("low")).alias("key"), "fp")
    if not crowded.limit(1).count():
        return keyed.select("block", "key", F.lit(0).cast("long").alias("leaf"), "fp", F.lit(False).alias("guest"))
    keyed = written(keyed, "keyed-fingerprints")
    counts = keyed.where("key < 0").groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    full = written(counts.select("block", "key", F.lit(True).alias("full")), "full-buckets")
    marked = keyed.join(full, ["block", "key"], "left")
    leftover = marked.where("full").select("fp").distinct()
    count = leftover.count()
    here = marked.where("full IS NULL").select("block", "key", F.lit(0).cast("long").alias("leaf"), "fp", F.lit(False).alias("guest"))
    if not count:
        return here
    shards = min(MAX_SHARDS, max(1, count // shard_rows))
    sample = np.array([r.fp for r in leftover.orderBy(F.xxhash64(F.lit(SEED), "fp")).limit(shards * SAMPLE_PER_SHARD).collect()], dtype=np.int64)
    tree = build_tree(np.sort(sample.view(np.uint64)), SAMPLE_PER_SHARD, radius)

    def deal(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy()
            row, leaf, guest = route(values.view(np.uint64), tree, radius)
            yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(row)), batch.column("key").take(pa.array(row)),
                                              pa.array(leaf.astype(np.int64)), pa.array(values[row]), pa.array(guest)], ["block", "key", "leaf", "fp", "guest"])

    return here.unionByName(marked.where("full").select("block", "key", "fp").mapInArrow(deal, "block int, key long, leaf long, fp long, guest boolean"))


def links(fingerprints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join every pair within the radius.

    Each shard returns a spanning forest of its pairs, at most one row per fingerprint in it.
    """
    def search(shard: pa.Table) -> pa.Table:
        values, guest = shard.column("fp").to_numpy(), shard.column("guest").to_numpy()
        ordered = np.concatenate([values[~guest], values[guest]])
        i, j = close_pairs(values[~guest].view(np.uint64), values[guest].view(np.uint64), radius)
        label = local_labels(i, j, len(ordered))
        linked = np.flatnonzero(label != np.arange(len(ordered)))
        return pa.table({"a": ordered[linked], "b": ordered[label[linked]]})

    key = ["block", "key", "leaf"]
    dealt = spread(partitioned(fingerprints, fingerprints.count(), radius, shard_rows), *key)
    return dealt.groupBy(*key).applyInArrow(search, "a long, b long")


def _components(rows: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``rows`` (doc_id, fp); ``root`` tells components apart, also without any id."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    found = components(links(classes.select("fp"), radius, shard_rows))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    low = (rooted.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("low")))
    named = (rooted.join(low, "component", "left")
             .select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("low", F.when(F.col("component").isNull(), F.col("first_id"))).alias("component_id")))
    return written(named, "fingerprint-components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    rows = written(with_fingerprints(docs), "fingerprints")
    return rows.join(_components(rows, radius, shard_rows), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _text_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells documents apart, none of it null: the id (or a stand-in), whether it is null, and two digests of the text."""
    text = F.col("text").cast("string")
    digests = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(SEED), text)})
    return digests.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.col("_t1")), "_none": F.col("doc_id").isNull().cast("long")})


def keep_first(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null ids last), of its texts the one of smallest digest.

    Different texts of one doc_id are documents of their own; rows equal in id and text are one document. Texts move once, by the whole key, so
    neither many copies of a text nor many rows of an id meet in one task.
    """
    key = ["_none", "_id", "_t1", "_t2"]
    rows = written(with_fingerprints(_text_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), tuple(key)), "fingerprints")
    first = rows.join(_components(rows.select("doc_id", "fp"), radius, shard_rows), "fp").groupBy("root").agg(F.min(F.struct(*key)).alias("f")).select("f.*")
    kept = _text_keys(docs).join(first, key, "left_semi").dropDuplicates(key)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
