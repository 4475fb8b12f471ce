"""Sentence and token similarity between reference and prediction with a pluggable encoder."""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from narralytics.functions import kernels
from narralytics.functions.plugins import CachedEncoder, CharHashingEncoder, Encoder, HashingEncoder, encode_column, strings
from narralytics.functions.text import sentences, tokens_13a
from narralytics.functions.words import Words, cut_13a, sentence_runs
from narralytics.operators.overlap_metrics import Scorer, overlap_counts, overlap_parts


def encode_sentences(df: DataFrame, key: str, texts: Sequence[str], make_encoder: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """(key, side, pos, sentence, vec) for the sentences of several text columns.

    Each distinct sentence is encoded once; adaptive skew handling splits a sentence that repeats a lot.
    """
    sides = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(t).alias("side"), sentences(F.col(t)).alias("list")) for t in texts])).alias("s"))
    flat = sides.select(key, "s.side", F.col("s.list").alias("list"))
    long = flat.select(key, "side", F.posexplode("list").alias("pos", "sentence"))
    keyed = long.withColumn("_k", F.unhex(F.md5("sentence")))  # sentences meet by a 16-byte digest, not by their text
    distinct = keyed.groupBy("_k").agg(F.min("sentence").alias("_s"))
    vectors = distinct.select("_k", encode_column(make_encoder)(F.col("_s")).alias("vec"))
    return keyed.join(vectors, "_k").drop("_k")


def summed_vectors(encoded: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, dim, value): the vectors of ``encode_sentences`` added up per key and dimension.

    Sentences are dealt by their digest, so a task that added them up there would hold sums for most keys, however many tasks
    there are. The vectors move to their keys first; a task then holds one row for each of its own keys.
    """
    moved = encoded.select(key, "vec").repartition(key)
    sums = moved.groupBy(key).agg(*[F.sum(F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return sums.select(key, F.posexplode(F.array(*[f"_{i}" for i in range(dim)])).alias("dim", "value"))


_DTW = StructType([StructField("dtw_distance", DoubleType()), StructField("normalized_dtw_distance", DoubleType())])


def _dtw_rows(refs: list[list[str]], hyps: list[list[str]], encoder: Encoder) -> np.ndarray:
    """(raw, over n + m) per row; NaN when either side has no sentence. All sentences of the rows are encoded in one call."""
    out = np.full((len(refs), 2), np.nan)
    at = [i for i, (r, h) in enumerate(zip(refs, hyps)) if r is not None and h is not None and len(r) and len(h)]
    if at:
        units = kernels.unit_rows(encoder.encode([s for i in at for side in (refs[i], hyps[i]) for s in side]))
        parts = np.split(units, np.cumsum([len(side) for i in at for side in (refs[i], hyps[i])])[:-1])
        out[at, 0] = kernels.dtw_costs(list(zip(parts[::2], parts[1::2])))
        out[at, 1] = out[at, 0] / [len(refs[i]) + len(hyps[i]) for i in at]
    return out


def _slices(lists: pa.ListArray, others: pa.ListArray, most: int = 20_000) -> Iterator[tuple[list, list]]:
    """Runs of rows with at most ``most`` list entries on both sides together, one row at least, as Python lists."""
    ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (lists, others)))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        rows = max(1, int(np.searchsorted(ends, before + most, side="right")) - start)
        yield lists.slice(start, rows).to_pylist(), others.slice(start, rows).to_pylist()
        start += rows


def _structs(values: np.ndarray, kind: StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(kind.fields))], kind.names)


def sentence_dtw(df: DataFrame, ref: str = "reference_narrative", hyp: str = "predicted_narrative", key: str = "sample_id",
                 make_encoder: Callable[[], Encoder] = HashingEncoder, counted: bool = False) -> DataFrame:
    """Time-warping distance between the sentence vectors of both texts, raw and over n + m; null
    when either side has no sentence. A narrow step over rows; a task encodes a repeated sentence once.
    ``counted``: ``df`` holds the columns of ``sentence_scorer``."""
    if counted:
        return _scored(df, key, _DTW)

    @F.arrow_udf(_DTW)
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = CachedEncoder(make_encoder(), 50_000)
        for refs, hyps in batches:
            found = [_dtw_rows(r, h, encoder) for r, h in _slices(refs, hyps)]
            yield _structs(np.concatenate([np.empty((0, 2)), *found]), _DTW)

    return _scored(df.select(key, score(sentences(F.col(ref)), sentences(F.col(hyp))).alias("s")).select(key, "s.*"), key, _DTW)


def sentence_scorer(make_encoder: Callable[[], Encoder] = HashingEncoder) -> tuple[list[str], Callable[[], Scorer]]:
    """The distances of ``sentence_dtw`` for a pass over texts that have been cut into words; NaN stands for null."""
    def make() -> Scorer:
        encoder = make_encoder()
        cached = CachedEncoder(encoder, 50_000)

        def score(texts, words: Words, tokens) -> list[np.ndarray]:
            rows = len(texts) // 2
            at, sentence, text = sentence_runs(words)
            names = strings(words.distinct)
            if hasattr(encoder, "encode_runs"):
                vectors = encoder.encode_runs(names, at, sentence, len(text))
            else:
                starts = np.searchsorted(sentence, np.arange(len(text) + 1)).tolist()
                vectors = cached.encode([" ".join([names[w] for w in at[a:b]]) for a, b in zip(starts, starts[1:])])
            bounds = np.searchsorted(text, np.arange(2 * rows + 1))
            hyps, refs = np.diff(bounds)[:rows], np.diff(bounds)[rows:]
            found, both = np.full((2, rows), np.nan), np.flatnonzero((hyps > 0) & (refs > 0))
            if len(both):
                units = kernels.unit_rows(vectors)
                side = lambda i: units[bounds[i]:bounds[i + 1]]
                found[0, both] = kernels.dtw_costs([(side(rows + i), side(i)) for i in both.tolist()])
                found[1] = found[0] / np.maximum(hyps + refs, 1)
            return [*found]

        return score

    return _DTW.names, make


def _scored(df: DataFrame, key: str, kind: StructType) -> DataFrame:
    return df.select(key, *[F.nanvl(f.name, F.lit(None)).alias(f.name) for f in kind.fields])


_PRF = StructType([StructField(f"bertscore_{n}", DoubleType()) for n in ("precision", "recall", "f1")])


def _best(own: np.ndarray, other: np.ndarray, sure: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Best cosine of every row of ``own`` with the rows of ``other``; a ``sure`` row stands there too, as its own best match."""
    best = np.einsum("ij,ij->i", own, own)
    rest = np.flatnonzero(~sure)
    for start in range(0, len(rest), chunk):
        at = rest[start:start + chunk]
        best[at] = (own[at] @ other.T).max(axis=1)
    return best


def _greedy(hyp: list[str], ref: list[str], encoder: Encoder) -> tuple[float, float, float]:
    """Mean best cosine of the tokens of each side, over distinct tokens weighted by their counts."""
    h, r = Counter(hyp), Counter(ref)
    hn, rn = np.array(list(h.values())), np.array(list(r.values()))
    hv, rv = np.split(kernels.unit_rows(encoder.encode([*h, *r])), [len(h)])
    # a token that stands on both sides needs no search, unless its vector is zero
    sure = lambda own, vectors, other: np.array([t in other for t in own]) & vectors.any(axis=1)
    best_h, best_r = _best(hv, rv, sure(h, hv, r)), _best(rv, hv, sure(r, rv, h))
    precision, recall = float(best_h @ hn / hn.sum()), float(best_r @ rn / rn.sum())
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def greedy_match(df: DataFrame, ref: str = "reference_narrative", hyp: str = "predicted_narrative", key: str = "sample_id",
                 make_encoder: Callable[[], Encoder] = CharHashingEncoder, counted: bool = False) -> DataFrame:
    """Token-level precision, recall and F1 by best cosine match; null when either text is blank.

    Per row only distinct tokens meet, inside the task, so no token pair is ever a row. ``counted``: ``df`` holds the
    columns of ``token_scorer``.
    """
    if counted:
        return _scored(df, key, _PRF)

    @F.arrow_udf(_PRF)
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = CachedEncoder(make_encoder())
        for hyps, refs in batches:
            rows = [_greedy(h, r, encoder) if h and r else (np.nan,) * 3 for some in _slices(hyps, refs) for h, r in zip(*some)]
            yield _structs(np.array(rows, dtype=float).reshape(-1, 3), _PRF)

    return _scored(df.select(key, score(tokens_13a(F.col(hyp)), tokens_13a(F.col(ref))).alias("s")).select(key, "s.*"), key, _PRF)


def token_scorer(make_encoder: Callable[[], Encoder] = CharHashingEncoder) -> tuple[list[str], Callable[[], Scorer]]:
    """The scores of ``greedy_match`` for a pass over texts that have been cut into words; NaN stands for null."""
    def make() -> Scorer:
        encoder = make_encoder()
        encoder = encoder if isinstance(encoder, CharHashingEncoder) else CachedEncoder(encoder)

        def score(texts, words: Words, tokens) -> list[np.ndarray]:
            rows = len(texts) // 2
            codes, lists, names = tokens(cut_13a)
            if not len(codes):
                return [np.full(rows, np.nan)] * 3
            units = kernels.unit_rows(encoder.encode(strings(names)))
            return [*_matched(units, *kernels.side_counts(codes, lists, rows), rows)]

        return score

    return _PRF.names, make


def _matched(units: np.ndarray, row: np.ndarray, token: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """Precision, recall and F1 of ``_greedy`` per row, from its distinct tokens (sorted by row) and their counts in hypothesis and reference."""
    on = counts > 0
    sure = on.all(axis=0) & units.any(axis=1)[token]
    best = np.tile(np.einsum("ij,ij->i", units, units)[token], (2, 1))
    bounds = np.searchsorted(row, np.arange(rows + 1)).tolist()
    blank = ~np.stack([np.bincount(row, s, rows) > 0 for s in on]).all(axis=0)
    rest = on & ~sure
    left = np.bincount(row, rest.any(axis=0), rows) > 0
    for i in np.flatnonzero(left & ~blank).tolist():
        a, b = bounds[i], bounds[i + 1]
        own = units[token[a:b]]
        for s in (0, 1):
            mine = on[s, a:b]
            if rest[s, a:b].any():
                best[s, a + np.flatnonzero(mine)] = _best(own[mine], own[on[1 - s, a:b]], sure[a:b][mine])
    with np.errstate(invalid="ignore", divide="ignore"):
        precision, recall = (np.bincount(row, best[s] * counts[s], rows) / np.bincount(row, counts[s], rows) for s in (0, 1))
        f1 = np.where(precision + recall != 0, 2 * precision * recall / (precision + recall), 0.0)
    return np.where(blank, np.nan, np.stack([precision, recall, f1]))


def text_scores(df: DataFrame, overlap: bool = True, semantic: bool = True, stemmer: bool = True, key: str = "sample_id") -> DataFrame:
    """One pass over the texts for ``overlap_metrics``, ``sentence_dtw`` and ``greedy_match``, which take its rows with ``counted``."""
    return overlap_counts(df, key, "predicted_narrative", "reference_narrative", overlap_parts(stemmer) if overlap else {},
                          [sentence_scorer(), token_scorer()] if semantic else [])


def semantic_summary(per_sample: DataFrame) -> DataFrame:
    """Means over rows, nulls skipped."""
    names = {"bertscore_f1_mean": "bertscore_f1", "dtw_distance_mean": "dtw_distance",
             "normalized_dtw_distance_mean": "normalized_dtw_distance"}
    wide = per_sample.agg(*[F.avg(c).alias(n) for n, c in names.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("r")).select("r.*")
