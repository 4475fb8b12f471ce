"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader.

Words are runs of letters, of digits or of other signs (ASCII lower-cased); features are hashed words and word
pairs; a word that equals the one before, or the one before that, is the same feature whatever the word. A document is the unit vector of its
damped counts, so its length does not weigh. Scoring is one sparse dot product per row in a narrow pass.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id, never on rows
whose crc32(doc_id) mod 3 is 1. Defined results: a null or blank text is scored by the bias alone; a null doc_id
is never a training row and has held_out false; a doc_id with several labels takes their largest; without any
label of a class every score is 0.5; repeated rows are scored alike; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import slices, utf8

TRAIN_ROWS = 8000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_REPEAT, _AGAIN = np.uint64(0x5DEECE66D1234567), np.uint64(0xA54FF53A5F1D36F1)
_KIND = np.zeros(256, dtype=np.uint8)            # 0 blank, 1 letter, 2 digit, 3 other
_KIND[33:] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    base = 0x100000001B3
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a byte array; equal words have equal hashes."""
    kind = _KIND[text]
    begins = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    ends = np.append(begins[1:], len(text))
    word = kind[begins] != 0
    starts, ends = begins[word], ends[word]
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((_LOWER[text].astype(np.uint64) + np.uint64(1)) * up[:len(text)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, (value ^ (value >> np.uint64(29))) * _PRIME


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit rows: (offsets, indices, values) over 2 ** bits slots; slot 0 is unused."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, words = word_hashes(joined, *_powers(len(joined)))
    lengths = np.array([len(t) + 1 for t in texts])
    row = np.searchsorted(np.cumsum(lengths), starts, side="right")
    pair = (words[:-1] * _MIX + words[1:]) * _PRIME
    pair[words[:-1] == words[1:]] = _REPEAT
    inside = row[:-1] == row[1:]
    again = (row[:-2] == row[2:]) & (words[:-2] == words[2:])
    slot = np.concatenate([words, pair[inside], np.full(again.sum(), _AGAIN)]) >> np.uint64(64 - bits)
    owner = np.concatenate([row, row[:-1][inside], row[:-2][again]])
    code, counts = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | slot, return_counts=True)
    owner, slot = (code >> np.uint64(bits)).astype(np.int64), (code & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return offsets.astype(np.int64), slot, value / norm[owner] if len(owner) else value


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    if not 0 < labels.mean() < 1:
        return np.zeros(1 << bits, np.float32), 0.0
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], bias), np.append(rows[k][1], 1.0)
            w = _weights(z[at], n[at], at == bias)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[at] += gradient - (np.sqrt(n[at] + gradient ** 2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += gradient ** 2
    w = _weights(z, n, np.arange(bias + 1) == bias)
    return w[:bias].astype(np.float32), float(w[bias])


def _weights(z, n, free):
    small = (np.abs(z) <= L1) & ~free
    return np.where(small, 0.0, -(z - np.sign(z) * np.where(free, 0, L1)) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> DataFrame:
    """(place, text, y) of the rows of at most ``limit`` labelled ids outside the held-out third; ``place`` orders them by value alone."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
             .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # the fit is on a bounded sample
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    return rows.select(F.xxhash64("doc_id", "text").alias("place"), "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on the bounded sample; its features, not its texts, reach the driver."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                offsets, slot, value = features(utf8(part.column("text")))
                at = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("place"), part.column("y"), pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], ["place", "y", "slot", "value"])

    sample = training_rows(docs, labels, label, limit).mapInArrow(run, "place long, y int, slot array<int>, value array<float>")
    rows, y = [], []
    got = sample.orderBy("place", "y", "slot").limit(2 * limit).toArrow()  # a doc_id may repeat; the sample stays bounded, whatever the file layout
    for batch in got.to_batches():
        slots, values = batch.column("slot"), batch.column("value")
        for k in range(batch.num_rows):
            rows.append((slots[k].values.to_numpy(), values[k].values.to_numpy()))
        y.extend(batch.column("y").to_pylist())
    if not rows:
        return np.zeros(1 << BITS, np.float32), 0.0
    order = np.lexsort(([r[1].sum() for r in rows], [r[0][:4].sum() for r in rows], [len(r[0]) for r in rows]))
    return ftrl([rows[k] for k in order], np.array(y)[order])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, quality_score and quality_predicted for every row; one narrow pass."""
    weights, bias = model
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                offsets, slot, value = features(utf8(part.column("quality_text")))
                total = np.concatenate([[0.0], np.cumsum(weights[slot] * value)])
                p = 1 / (1 + np.exp(-np.clip(total[offsets[1:]] - total[offsets[:-1]] + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    [*keep, "quality_score", "quality_predicted"])

    return docs.select(*keep, F.col("text").cast("string").alias("quality_text")).mapInArrow(
        run, f"{schema}, quality_score double, quality_predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, labels)).select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    names = tuple(docs.columns)
    return score(docs, fit(docs, labels), keep=names).where("quality_predicted = 1").select(*names)
