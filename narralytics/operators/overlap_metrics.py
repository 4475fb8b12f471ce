"""BLEU and ROUGE from clipped n-gram counts.

Everything is counted per row, in one narrow step: both texts go to an Arrow kernel that tokenises every distinct
word of some rows once and numbers their n-grams. No n-gram is ever a row, and no text is shuffled.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.functions import kernels
from narralytics.functions.words import Cut, Words, make_13a, make_alnum, make_stems, named_tokens
from narralytics.session import stored

ORDERS = (1, 2, 3, 4)
BLEU_STATS = ["hyp_len", "ref_len"] + [f"match_{n}" for n in ORDERS] + [f"total_{n}" for n in ORDERS]
KERNEL_ROWS, KERNEL_BYTES = 256, 4_000_000  # most rows whose words are tokenised together, and most bytes of their texts
COUNTED_ROWS = 128  # rows whose n-grams are numbered together

#: From some texts (all hypotheses, then all references), their words and a function that gives the named tokens of a tokeniser: columns of numbers.
Scorer = Callable[[pa.Array, Words, Callable[[Cut], tuple[np.ndarray, np.ndarray, pa.Array]]], list[np.ndarray]]


def _counted(tokens: np.ndarray, lists: np.ndarray, rows: int, systems: int, orders: Sequence[int], lcs: bool) -> list[np.ndarray]:
    """Per system, columns for the numbered tokens of some rows: match, hyp, ref per order, then lcs with both lengths."""
    columns: list[list[np.ndarray]] = [[] for _ in range(systems)]
    found = []
    for start in range(0, rows if orders else 0, COUNTED_ROWS):
        some = min(COUNTED_ROWS, rows - start)
        bounds = [np.searchsorted(lists, [s * rows + start, s * rows + start + some]) for s in range(systems + 1)]
        flat = np.concatenate([tokens[a:b] for a, b in bounds])
        of = np.concatenate([lists[a:b] - s * (rows - some) - start for s, (a, b) in enumerate(bounds)])
        found.append(kernels.clipped_counts(flat, of, some, tuple(orders), systems))
    for s in range(systems):
        columns[s] += [c for n in orders for c in np.concatenate([f[n][3 * s:3 * s + 3] for f in found], axis=1)]
    if lcs:
        lengths = np.bincount(lists, minlength=(systems + 1) * rows).reshape(systems + 1, rows)
        first, last = np.searchsorted(lists, np.arange(systems + 1) * rows), np.searchsorted(lists, np.arange(1, systems + 2) * rows)
        for s in range(systems):
            two = [np.arange(first[x], last[x]) for x in (s, systems)]
            of = np.concatenate([lists[two[0]] - s * rows, lists[two[1]] - (systems - 1) * rows])
            columns[s] += [kernels.lcs_lengths(tokens[np.concatenate(two)], of, rows), lengths[s], lengths[-1]]
    return [c for some in columns for c in some]


def _row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``KERNEL_ROWS`` rows and ``KERNEL_BYTES`` bytes of text, one row at least."""
    lists = batch.column("_t")
    sizes = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes.reshape(batch.num_rows, -1).sum(axis=1))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        rows = max(1, min(KERNEL_ROWS, int(np.searchsorted(ends, before + KERNEL_BYTES, side="right")) - start))
        yield batch.slice(start, rows)
        start += rows


def overlap_counts(df: DataFrame, key: str, hyp: str | Mapping[str, str], ref: str,
                   parts: dict[str, tuple[Callable[[], Cut], Sequence[int], bool]],
                   scorers: Sequence[tuple[Sequence[str], Callable[[], Scorer]]] = ()) -> DataFrame:
    """Per row and part (prefix -> tokeniser, orders, whether to find the longest common subsequence):
    ``<prefix>match_n``, ``<prefix>hyp_n``, ``<prefix>ref_n``, and ``<prefix>lcs`` with both lengths.

    Several systems (prefix -> column) may be counted against one reference; their prefix comes before that of the part.
    ``scorers`` (names, maker) add columns of doubles for one system, from the same words and tokens.
    """
    systems = {"": hyp} if isinstance(hyp, str) else dict(hyp)
    texts = df.select(key, F.array(*[F.col(c).cast("string") for c in (*systems.values(), ref)]).alias("_t"))
    ordered = [f"{s}{name}" for p, (_, orders, lcs) in parts.items() for s in systems for name in
               [f"{p}{side}_{n}" for n in orders for side in ("match", "hyp", "ref")] + [f"{p}{x}" for x in ("lcs", "hyp_len", "ref_len") if lcs]]

    scores = [n for names, _ in scorers for n in names]

    def run(batches):
        cuts, made = {p: make() for p, (make, _, _) in parts.items()}, [make() for _, make in scorers]
        for batch in batches:
            for some in _row_slices(batch):
                rows, flat = some.num_rows, some.column("_t").flatten()
                sides = flat.take(pa.array(np.arange(len(flat)).reshape(rows, -1).T.ravel()))     # a system's texts, then the next one's
                words = Words(sides)
                tokens = lru_cache(maxsize=None)(lambda cut: named_tokens(sides, cut, words))      # noqa: B023
                counts = [c for p, (_, orders, lcs) in parts.items() for c in _counted(*tokens(cuts[p])[:2], rows, len(systems), orders, lcs)]
                found = [c for score in made for c in score(sides, words, tokens)]
                yield pa.RecordBatch.from_arrays([some.column(key), *[pa.array(c.astype(np.int64)) for c in counts], *[pa.array(c.astype(float)) for c in found]],
                                                 [key, *ordered, *scores])

    kind = dict(df.dtypes)[key]
    return texts.mapInArrow(run, f"`{key}` {kind}, " + ", ".join([*[f"{n} long" for n in ordered], *[f"{n} double" for n in scores]]))


BLEU_PART, ROUGE_1_PART = {"b_": (make_13a, ORDERS, False)}, {"r_": (make_alnum, (1,), False)}


def system_counts(df: DataFrame, hyps: Mapping[str, str], ref: str = "reference_narrative", key: str = "sample_id") -> dict[str, DataFrame]:
    """The counts of ``bleu_statistics`` and of ``rouge_n`` (order 1, no stemmer) per system (name -> column of its texts).

    The texts are read and tokenised once for all systems; the counts are written once.
    """
    counts = stored(overlap_counts(df, key, {f"{s}_": c for s, c in hyps.items()}, ref, BLEU_PART | ROUGE_1_PART), "overlap-counts")
    names = [c.removeprefix(f"{next(iter(hyps))}_") for c in counts.columns if c.startswith(f"{next(iter(hyps))}_")]
    return {s: counts.select(key, *[F.col(f"{s}_{n}").alias(n) for n in names]) for s in hyps}


def bleu_statistics(df: DataFrame, hyp: str = "predicted_narrative", ref: str = "reference_narrative",
                    key: str = "sample_id", counted: bool = False) -> DataFrame:
    """Ten integers per sample; everything BLEU needs afterwards is a sum of them. ``counted``: ``df`` holds the counts."""
    counts = df if counted else overlap_counts(df, key, hyp, ref, BLEU_PART)
    return counts.select(key, *_bleu_columns())


def _bleu_columns() -> list[Column]:
    return [F.col("b_hyp_1").alias("hyp_len"), F.col("b_ref_1").alias("ref_len"), *[F.col(f"b_match_{n}").alias(f"match_{n}") for n in ORDERS],
            *[F.col(f"b_hyp_{n}").alias(f"total_{n}") for n in ORDERS]]


def bleu_score(prefix: str = "", effective_order: bool = False) -> Column:
    """BLEU (0-100) of summed statistics, exponential smoothing of empty orders."""
    match = {n: F.col(f"{prefix}match_{n}").cast("double") for n in ORDERS}
    total = {n: F.col(f"{prefix}total_{n}").cast("double") for n in ORDERS}
    hyp, ref = F.col(f"{prefix}hyp_len").cast("double"), F.col(f"{prefix}ref_len").cast("double")
    halvings, log_sum, reached = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in ORDERS:
        empty = (match[n] == 0) & (total[n] > 0)
        halvings = halvings + F.when(empty, 1.0).otherwise(0.0)
        precision = F.when(empty, 100.0 / (F.pow(F.lit(2.0), halvings) * total[n])).otherwise(100.0 * match[n] / total[n])
        log_sum = log_sum + F.when(total[n] > 0, F.ln(precision)).otherwise(0.0)
        reached = reached + F.when(total[n] > 0, 1).otherwise(0)
    brevity = F.when(hyp >= ref, 1.0).otherwise(F.exp(1.0 - ref / hyp))
    nothing = (match[1] + match[2] + match[3] + match[4] == 0) | (hyp == 0)
    if effective_order:
        return F.when(nothing, 0.0).otherwise(brevity * F.exp(log_sum / reached))
    return F.when(nothing | (reached < len(ORDERS)), 0.0).otherwise(brevity * F.exp(log_sum / len(ORDERS)))


def sum_statistics(prefix: str = "") -> list[Column]:
    return [F.sum(f"{prefix}{c}").alias(f"{prefix}{c}") for c in BLEU_STATS]


def corpus_bleu(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return stats.groupBy(*by).agg(*sum_statistics()).select(*by, bleu_score().alias("bleu_corpus"))


def sentence_bleu(stats: DataFrame, key: str = "sample_id") -> DataFrame:
    return stats.select(key, bleu_score(effective_order=True).alias("bleu_sentence"))


def _prf(match: Column, hyp: Column, ref: Column, name: str) -> list[Column]:
    precision = match / F.greatest(hyp, F.lit(1))
    recall = match / F.greatest(ref, F.lit(1))
    f = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))
    return [precision.alias(f"{name}_precision"), recall.alias(f"{name}_recall"), f.alias(f"{name}_fmeasure")]


def rouge_n(df: DataFrame, hyp: str = "predicted_narrative", ref: str = "reference_narrative",
            key: str = "sample_id", orders: Sequence[int] = (1, 2), stemmer: bool = True, counted: bool = False) -> DataFrame:
    """Precision, recall and F per sample and order. ``counted``: ``df`` holds the counts."""
    counts = df if counted else overlap_counts(df, key, hyp, ref, {"r_": (make_stems if stemmer else make_alnum, orders, False)})
    return counts.select(key, *_rouge_columns(orders))


def _rouge_columns(orders: Sequence[int]) -> list[Column]:
    return [c for n in orders for c in _prf(F.col(f"r_match_{n}"), F.col(f"r_hyp_{n}"), F.col(f"r_ref_{n}"), f"rouge{n}")]


def rouge_l(df: DataFrame, hyp: str = "predicted_narrative", ref: str = "reference_narrative",
            key: str = "sample_id", stemmer: bool = True) -> DataFrame:
    """Longest common subsequence over the whole text; a narrow per-row step without a shuffle."""
    counts = overlap_counts(df, key, hyp, ref, {"r_": (make_stems if stemmer else make_alnum, (), True)})
    return counts.select(key, *_prf(F.col("r_lcs"), F.col("r_hyp_len"), F.col("r_ref_len"), "rougeL"))


def overlap_parts(stemmer: bool = True) -> dict[str, tuple[Callable[[], Cut], Sequence[int], bool]]:
    return BLEU_PART | {"r_": (make_stems if stemmer else make_alnum, (1, 2), True)}


def overlap_metrics(df: DataFrame, key: str = "sample_id", stemmer: bool = True, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-sample BLEU/ROUGE table and its long (metric, value) summary, from one pass over the texts. ``counted``: ``df`` holds the counts."""
    counts = df if counted else overlap_counts(df, key, "predicted_narrative", "reference_narrative", overlap_parts(stemmer))
    rouge = [*_rouge_columns((1, 2)), *_prf(F.col("r_lcs"), F.col("r_hyp_len"), F.col("r_ref_len"), "rougeL")]
    per_sample = counts.select(key, *_bleu_columns(), *rouge).withColumn("bleu_sentence", bleu_score(effective_order=True))
    totals = per_sample.agg(
        *sum_statistics(), F.avg("bleu_sentence").alias("bleu_sentence_mean"),
        *[F.avg(f"{r}_fmeasure").alias(f"{r}_mean") for r in ("rouge1", "rouge2", "rougeL")])
    wide = totals.withColumn("bleu_corpus", bleu_score())
    names = ["bleu_corpus", "bleu_sentence_mean", "rouge1_mean", "rouge2_mean", "rougeL_mean"]
    summary = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("r")).select("r.*")
    return per_sample.drop(*BLEU_STATS), summary
