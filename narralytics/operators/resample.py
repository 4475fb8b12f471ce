"""Bootstraps: replicates are rows, draws are computed in place, sums are pre-aggregated.

Rows are cut into blocks. The draws of a replicate are split over the blocks by seeded binomials, each
block resamples its own rows, and nothing but per-block sums is shuffled; label bootstraps draw the cells of
the label table as one multinomial. This is the one way at every table size. ``portable=True`` draws row by row
with a hash that any SQL engine can repeat, at every size too; it is meant for checks against SQL.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from narralytics.constants import EMOTION_LABELS, LOWER_IS_BETTER
from narralytics.functions.draws import draw_index
from narralytics.functions.labels import label_code
from narralytics.operators.overlap_metrics import BLEU_STATS, bleu_score
from narralytics.operators.ranking import rank_by_value
from narralytics.session import cut_lineage

DEFAULT_SAMPLES = 10_000
BROADCAST_VALUES = 500_000  # values of a table that is sent to every task: 4 MB of doubles
BLOCK_ROWS = 65_536
ZERO = 1e-12  # distributed sums differ in their last bits; replicates this close to 0 count as ties


def indexed(df: DataFrame, ordinal: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``idx``, the zero-based position of a row within its group.

    The result is written once: sizes, draws and point estimates all read the indexed table.
    """
    ranked = rank_by_value(df, ordinal, groups, "_rank")
    return cut_lineage(ranked.withColumn("idx", F.col("_rank") - 1).drop("_rank"))


def group_sizes(stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    return stats.groupBy(*groups).agg(F.count("*").alias("n"))


def replicates(sizes: DataFrame, samples: int, groups: Sequence[str]) -> DataFrame:
    """One row per group and replicate, spread over the cluster."""
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return exploded.repartition(width, *groups, "replicate")


def drawn_sums(reps: DataFrame, stats: DataFrame, groups: Sequence[str], keys: Sequence[str], values: Sequence[str],
               seed: int, portable: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Sums over n draws with replacement per row of ``reps`` (its ``n`` rows of its group).

    The slots of a replicate stay in its partition. A small table is sent to every task; draws from a larger one are packed
    by blocks of rows and meet their block, with the same result.
    """
    draws = reps.withColumn("_rep", F.monotonically_increasing_id()).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    picked = draws.withColumn("idx", draw_index(F.col("n"), seed, *[F.col(k) for k in keys], F.col("slot"), portable=portable))
    table = stats.select(*groups, "idx", *values, *extra)
    by = [*keys, *[g for g in groups if g not in keys], *extra]
    if stats.count() * (1 + len(groups) + len(values) + len(extra)) > BROADCAST_VALUES:
        return _drawn_in_blocks(picked, table, groups, by[:len(by) - len(extra)], values, extra).groupBy(*by).agg(
            *[F.sum(v).alias(v) for v in values], F.sum("draws").alias("draws"))
    joined = picked.join(F.broadcast(table), [*groups, "idx"])
    return joined.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("draws"))


def _drawn_in_blocks(picked: DataFrame, table: DataFrame, groups: Sequence[str], carried: Sequence[str], values: Sequence[str],
                     extra: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(carried, extra, values, draws) per block of ``block_rows`` rows of a group: sums over the draws that fall into it.

    Only four bytes a draw are shuffled; a task holds one block and the draws that fall into it.
    """
    groups, carried, values, extra = list(groups), list(carried), list(values), list(extra)
    types = {f.name: f.dataType.simpleString() for f in [*table.schema.fields, *picked.schema.fields]}
    whole = [types[v] in ("tinyint", "smallint", "int", "bigint") for v in values]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, idx = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_rep", "idx"))
            block = idx // block_rows
            order = np.lexsort((block, rep))
            rep, block = rep[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], (rep[1:] != rep[:-1]) | (block[1:] != block[:-1])]))
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            at = pa.ListArray.from_arrays(ends, pa.array((idx[order] - block * block_rows).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(order[first])) for c in [*carried, "_rep"]], pa.array(block[first]), at],
                                             [*carried, "_rep", "_block", "_at"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right.column("idx").to_numpy()
        right = right.take(pa.array(np.argsort(places, kind="stable")))
        columns = [right.column(v) for v in values]
        known = np.array([c.is_valid().to_numpy() for c in columns]).T.reshape(len(right), len(values)).astype(float)
        matrix = np.array([np.where(c.is_valid().to_numpy(), c.to_numpy(), 0) for c in columns], dtype=float).T.reshape(len(right), len(values))
        cells, code = [0], np.zeros(len(right), dtype=np.int64)
        if extra:
            code = right.select(extra).to_pandas().groupby(extra, dropna=False).ngroup().to_numpy()
            cells = np.unique(code, return_index=True)[1]
        _, start, rep = np.unique(left.column("_rep").to_numpy(), return_index=True, return_inverse=True)
        left = left.combine_chunks()
        lists = left.column("_at").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        rows, of_cell, sums, seen, draws = [], [], [], [], []
        finite = np.isfinite(matrix).all()
        by_rep = np.argsort(rep, kind="stable")
        for number, mine in enumerate(np.split(by_rep, np.flatnonzero(np.diff(rep[by_rep])) + 1)):
            weight = np.bincount(np.concatenate([flat[ends[i]:ends[i + 1]] for i in mine]), minlength=len(right)).astype(float)
            count = np.bincount(code, weight, len(cells))
            hit = np.flatnonzero(count)
            rows += [start[number]] * len(hit)
            of_cell.append(hit)
            draws.append(count[hit])
            if not values:
                continue
            if len(cells) == 1 and finite:
                sums.append((weight @ matrix)[None, :]), seen.append((weight @ known)[None, :])
            else:
                drawn = weight > 0      # an undrawn infinite value adds nothing
                sums.append(np.column_stack([np.bincount(code[drawn], weight[drawn] * matrix[drawn, j], len(cells)) for j in range(len(values))])[hit])
                seen.append(np.column_stack([np.bincount(code[drawn], weight[drawn] * known[drawn, j], len(cells)) for j in range(len(values))])[hit])
        out = [left.column(c).take(pa.array(rows)) for c in carried]
        out += [right.column(c).take(pa.array(cells[np.concatenate(of_cell)])) for c in extra]
        for j, integral in enumerate(whole):
            total, empty = np.concatenate(sums)[:, j], np.concatenate(seen)[:, j] == 0
            out.append(pa.array(total.astype(np.int64) if integral else total, mask=empty))
        return pa.Table.from_arrays([*out, pa.array(np.concatenate(draws).astype(np.int64))], [*carried, *extra, *values, "draws"])

    def schema(names: Sequence[str]) -> list[str]:
        return [f"`{c}` {types[c]}" for c in names]

    packed = picked.select(*carried, "_rep", "idx").dropna(subset=groups).mapInArrow(
        pack, ", ".join([*schema(carried), "_rep long", "_block long", "_at array<int>"]))
    blocks = table.dropna(subset=groups).withColumn("_block", F.floor(F.col("idx") / block_rows).cast("long"))
    result = ", ".join([*schema([*carried, *extra]), *[f"`{v}` {'long' if w else 'double'}" for v, w in zip(values, whole)], "draws long"])
    return packed.groupBy(*groups, "_block").cogroup(blocks.groupBy(*groups, "_block")).applyInArrow(
        lambda left, right: meet(left, right) if len(left) else _nothing(result), result)


def _nothing(schema: str) -> pa.Table:
    """An empty Arrow table of a schema in SQL notation."""
    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def resampled_sums(stats: DataFrame, values: Sequence[str], groups: Sequence[str], samples: int, seed: int,
                   portable: bool = False) -> DataFrame:
    """(groups, replicate, summed values, draws) of a row bootstrap over an indexed table."""
    if portable:
        reps = replicates(group_sizes(stats, groups), samples, groups)
        return drawn_sums(reps, stats, groups, [*groups, "replicate"], values, seed, True)
    return block_sums(stats, values, groups, samples, seed)


def _node_draws(n: int, block_rows: int, block: int, samples: int, seed: list[int]) -> np.ndarray:
    """Draws falling into one block per replicate, by walking down a binary tree of binomials.

    Each node's generator is keyed by the node, so every block sees the same splits above it. All blocks but the last hold
    ``block_rows`` rows, so the rows below a node follow from its ends and a block costs the logarithm of their number.
    """
    def rows(low: int, high: int) -> int:
        return min(high * block_rows, n) - low * block_rows

    low, high = 0, -(-n // block_rows)
    counts = np.full(samples, n, dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(counts, rows(low, mid) / rows(low, high))
        counts, low, high = (left, low, mid) if block < mid else (counts - left, mid, high)
    return counts


def block_sums(stats: DataFrame, values: Sequence[str], groups: Sequence[str], samples: int, seed: int,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bootstrap sums for tables of any size; a task holds one block of rows."""
    names, cols = list(groups), list(values)
    sizes = group_sizes(stats, groups).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(names)], "n")
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(names)], F.lit(True))
    sized = stats.join(sizes, same) if names else stats.withColumn("n", F.lit(stats.count()).cast("long"))
    blocks = sized.withColumn("_block", F.floor(F.col("idx") / block_rows).cast("long"))

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, block = int(pdf["n"].iloc[0]), int(key[-1])
        base = [seed, zlib.crc32(repr(key[:-1]).encode())]
        counts = _node_draws(n, block_rows, block, samples, base)
        matrix = pdf.sort_values("idx")[cols].to_numpy(dtype=float)
        rng = np.random.default_rng([*base, -(-n // block_rows), block])
        sums = np.empty((samples, len(cols)))
        for b in range(samples):
            weights = np.bincount(rng.integers(0, len(matrix), counts[b]), minlength=len(matrix))
            sums[b] = weights @ matrix
        out = pd.DataFrame(sums, columns=cols)
        for name, value in zip(names, key[:-1]):
            out[name] = value
        return out.assign(replicate=np.arange(samples, dtype=np.int32), draws=counts)

    types = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join([f"{c} double" for c in cols] + [f"{g} {types[g]}" for g in names] + ["replicate int", "draws long"])
    parts = blocks.select(*names, "_block", "idx", "n", *cols).groupBy(*names, "_block").applyInPandas(resample, schema)
    return parts.groupBy(*names, "replicate").agg(*[F.sum(c).alias(c) for c in cols], F.sum("draws").alias("draws"))


def summarise(distribution: DataFrame, points: DataFrame, by: Sequence[str], p_smoothing: bool = True,
              value: str = "value") -> DataFrame:
    """Percentile interval, two-sided p and significance of a replicate distribution.

    ``p_smoothing`` adds one to the tail counts and to the number of replicates.
    """
    add = 1 if p_smoothing else 0
    stats = distribution.groupBy(*by).agg(
        F.percentile(value, F.lit(0.025)).alias("ci_95_low"), F.percentile(value, F.lit(0.975)).alias("ci_95_high"),
        F.count_if(F.col(value) <= ZERO).alias("_low"), F.count_if(F.col(value) >= -ZERO).alias("_high"), F.count("*").alias("_b"))
    tail = F.least(F.col("_low"), F.col("_high"))
    tested = stats.withColumn("p_value", F.least(F.lit(1.0), 2.0 * (tail + add) / (F.col("_b") + add))).withColumn(
        "significant_95", (F.col("ci_95_low") > 0) | (F.col("ci_95_high") < 0)).drop("_low", "_high", "_b")
    return points.join(tested, list(by))


def favoured(first: str, second: str, metric: Column | None = None, none: str = "no_significant_difference",
             lower_is_better: Sequence[str] = tuple(LOWER_IS_BETTER)) -> Column:
    """Side the interval favours; swapped for a metric where lower is better."""
    swap = F.lit(False) if metric is None else metric.isin(list(lower_is_better))
    up = F.when(swap, F.lit(second)).otherwise(F.lit(first))
    down = F.when(swap, F.lit(first)).otherwise(F.lit(second))
    return F.when(F.col("ci_95_low") > 0, up).when(F.col("ci_95_high") < 0, down).otherwise(F.lit(none))


def paired_bootstrap(pairs: DataFrame, metrics: dict[str, str], ordinal: str = "sample_id", groups: Sequence[str] = (),
                     samples: int = DEFAULT_SAMPLES, seed: int = 42, bleu: bool = True, portable: bool = False) -> DataFrame:
    """Paired row bootstrap of mean metrics and corpus BLEU with shared draws.

    ``pairs`` holds ``<column>_a``/``<column>_b`` per metric and, for BLEU, the statistics of both
    systems as ``a_*``/``b_*``. Groups are independent comparisons done in the same job.
    """
    sides = [f"{c}_{s}" for c in metrics.values() for s in "ab"] + ([f"{s}_{c}" for s in "ab" for c in BLEU_STATS] if bleu else [])
    stats = indexed(pairs.select(*groups, ordinal, *sides), ordinal, groups)

    def scores(sums: DataFrame, n: Column, keep: Sequence[str]) -> DataFrame:
        rows = [F.struct(F.lit(m).alias("metric"), (F.col(f"{c}_a") / n).alias("a"), (F.col(f"{c}_b") / n).alias("b"))
                for m, c in metrics.items()]
        if bleu:
            rows.append(F.struct(F.lit("bleu_corpus").alias("metric"), bleu_score("a_").alias("a"), bleu_score("b_").alias("b")))
        return sums.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")

    sums = resampled_sums(stats, sides, groups, samples, seed, portable)
    distribution = scores(sums, F.col("draws"), [*groups, "replicate"]).withColumn("value", F.col("a") - F.col("b"))
    totals = stats.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in sides], F.count("*").alias("draws"))
    points = scores(totals, F.col("draws"), groups).select(
        *groups, "metric", F.col("a").alias("model_a"), F.col("b").alias("model_b"), (F.col("a") - F.col("b")).alias("difference"))
    return summarise(distribution, points, [*groups, "metric"]).withColumn("favored", favoured("model_a", "model_b", F.col("metric")))


# --- label bootstraps ------------------------------------------------------------------------

def label_cells(pairs: DataFrame, groups: Sequence[str], ordinal: str = "sample_id", gold: str = "gold", a: str = "pred_a",
                b: str = "pred_b", labels: Sequence[str] = tuple(EMOTION_LABELS)) -> DataFrame:
    """Indexed rows with integer label codes; unknown labels share the last code."""
    coded = pairs.select(*groups, ordinal, *[label_code(F.col(c), list(labels)).alias(o) for c, o in ((gold, "g"), (a, "a"), (b, "c"))])
    return indexed(coded, ordinal, groups)


def label_score_differences(counts: DataFrame, keys: Sequence[str], label_count: int = len(EMOTION_LABELS)) -> DataFrame:
    """Accuracy and fixed-vocabulary macro-F1 of both systems from cell counts (keys, g, a, c, draws)."""
    n = F.col("draws")
    roles = counts.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(system).alias("system"), F.lit(role).alias("role"), F.col(source).alias("label"),
                 F.when((F.lit(role) != "tp") | (F.col("g") == F.col(pred)), n).otherwise(0).alias("n"))
        for system, pred in (("a", "a"), ("b", "c"))
        for role, source in (("support", "g"), ("predicted", pred), ("tp", "g"))])).alias("r")).select(*keys, "r.*")
    per_label = roles.groupBy(*keys, "system", "label").agg(*[
        F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0)).alias(role) for role in ("support", "predicted", "tp")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    known_label = F.col("label") < label_count
    per_system = per_label.groupBy(*keys, "system").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(F.when(known_label, f1).otherwise(0.0)) / label_count).alias("macro_f1"))
    pick = lambda s, m: F.max(F.when(F.col("system") == s, F.col(m)))
    wide = per_system.groupBy(*keys).agg(*[pick(s, m).alias(f"{m}_{s}") for s in "ab" for m in ("accuracy", "macro_f1")])
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("value")) for m in ("accuracy", "macro_f1")
    ])).alias("r")).select(*keys, "r.*")


def cell_totals(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    return cells.groupBy(*groups, "g", "a", "c").agg(F.count("*").alias("draws"))


def multinomial_cells(reps: DataFrame, cells: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """Replicate cell counts for tables of any size.

    Rows with equal labels are exchangeable, so resampling rows is one multinomial draw over at most
    8 x 8 x 8 cells; the cost does not depend on the number of rows.
    """
    carried = list(dict.fromkeys([*keys, *groups]))
    packed = cell_totals(cells, groups).groupBy(*groups).agg(
        F.sort_array(F.collect_list(F.struct("g", "a", "c", "draws"))).alias("cells"))
    work = reps.join(packed, list(groups)).select(*carried, "cells")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                counts = np.array([c["draws"] for c in record["cells"]])
                key = zlib.crc32(repr([record[k] for k in carried]).encode())
                drawn = np.random.default_rng([seed, key]).multinomial(counts.sum(), counts / counts.sum())
                same = {k: record[k] for k in carried}
                rows += [{**same, "g": c["g"], "a": c["a"], "c": c["c"], "draws": int(d)} for c, d in zip(record["cells"], drawn) if d]
            yield pd.DataFrame(rows)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name != "cells"]
                       + ["g int", "a int", "c int", "draws long"])
    return work.mapInPandas(draw, schema)


def replicate_cells(reps: DataFrame, cells: DataFrame, groups: Sequence[str], keys: Sequence[str],
                    seed: int, portable: bool) -> DataFrame:
    """Cell counts per replicate, as multinomials; row by row only when the draws have to be portable."""
    if portable:
        return drawn_sums(reps, cells, groups, keys, [], seed, True, extra=["g", "a", "c"])
    return multinomial_cells(reps, cells, groups, keys, seed)


def label_bootstrap(pairs: DataFrame, groups: Sequence[str] = ("dataset",), samples: int = DEFAULT_SAMPLES, seed: int = 42,
                    portable: bool = False, p_smoothing: bool = False) -> DataFrame:
    """Paired bootstrap of the accuracy and macro-F1 differences (second system minus first)."""
    cells = label_cells(pairs, groups)
    keys = [*groups, "replicate"]
    sizes = group_sizes(cells, groups)
    counts = replicate_cells(replicates(sizes, samples, groups), cells, groups, keys, seed, portable)
    distribution = label_score_differences(counts, keys)
    points = label_score_differences(cell_totals(cells, groups), groups).withColumnRenamed("value", "difference")
    return summarise(distribution, points, [*groups, "metric"], p_smoothing)


# --- hierarchical bootstraps -----------------------------------------------------------------

def seed_draws(sizes: DataFrame, groups: Sequence[str], samples: int, seed: int, portable: bool) -> DataFrame:
    """(groups, replicate, seed_slot, seed): as many seeds drawn per replicate as there are."""
    listed = sizes.groupBy(*groups).agg(F.sort_array(F.collect_list("seed")).alias("seeds"))  # one entry per training seed
    slots = (listed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
             .withColumn("seed_slot", F.explode(F.sequence(F.lit(1), F.size("seeds")))))
    drawn = draw_index(F.size("seeds"), seed, F.lit("seed"), *[F.col(g) for g in groups], F.col("replicate"), F.col("seed_slot"), portable=portable)
    return slots.withColumn("seed", F.get(F.col("seeds"), drawn.cast("int"))).drop("seeds")


def hierarchical_means(rows: DataFrame, values: Sequence[str], groups: Sequence[str] = ("dataset",), samples: int = DEFAULT_SAMPLES,
                       seed: int = 20260824, ordinal: str = "sample_id", portable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replicate means and point means of value columns, resampling rows within seed, then seeds.

    A (seed, replicate) row sample is drawn once and reused when that seed is drawn twice. All value
    columns share the draws, so any number of metrics and contrasts costs one pass.
    """
    by_seed = [*groups, "seed"]
    stats = indexed(rows.select(*by_seed, ordinal, *values), ordinal, by_seed)
    within = resampled_sums(stats, values, by_seed, samples, seed, portable)
    means = within.select(*by_seed, "replicate", *[(F.col(v) / F.col("draws")).alias(v) for v in values])
    chosen = seed_draws(group_sizes(stats, by_seed), groups, samples, seed, portable)
    distribution = chosen.join(means, [*by_seed, "replicate"]).groupBy(*groups, "replicate").agg(*[F.avg(v).alias(v) for v in values])
    points = rows.groupBy(*by_seed).agg(*[F.avg(v).alias(v) for v in values]).groupBy(*groups).agg(*[F.avg(v).alias(v) for v in values])
    return distribution, points


def long_values(df: DataFrame, keys: Sequence[str], names: dict[str, dict[str, str]], value: str) -> DataFrame:
    """Value columns to rows; ``names`` maps a column to the key columns it stands for."""
    return df.select(*keys, F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in tags.items()], F.col(c).alias(value)) for c, tags in names.items()])).alias("r")).select(*keys, "r.*")


def hierarchical_contrasts(cells: DataFrame, metrics: Sequence[str], contrasts: dict[str, dict[str, float]],
                           groups: Sequence[str] = ("dataset",), samples: int = DEFAULT_SAMPLES, seed: int = 20260824,
                           lower_is_better: Sequence[str] = tuple(LOWER_IS_BETTER), portable: bool = False) -> DataFrame:
    """Hierarchical bootstrap of linear contrasts between conditions, direction-corrected.

    ``cells`` has one row per (groups, seed, sample_id) and a column ``<metric>__<condition>`` each.
    """
    names: dict[str, dict[str, str]] = {}
    columns = []
    for m_index, metric in enumerate(metrics):
        sign = -1.0 if metric in lower_is_better else 1.0
        for c_index, (contrast, weights) in enumerate(contrasts.items()):
            total = F.lit(0.0)
            for condition, weight in weights.items():
                total = total + F.lit(sign * weight) * F.col(f"{metric}__{condition}")
            name = f"v{m_index}_{c_index}"
            columns.append(total.alias(name))
            names[name] = {"metric": metric, "contrast": contrast}
    rows = cells.select(*groups, "seed", "sample_id", *columns)
    distribution, points = hierarchical_means(rows, list(names), groups, samples, seed, portable=portable)
    by = [*groups, "metric", "contrast"]
    return summarise(long_values(distribution, groups, names, "value"), long_values(points, groups, names, "effect"), by)


def hierarchical_label_bootstrap(pairs: DataFrame, groups: Sequence[str] = ("dataset",), samples: int = DEFAULT_SAMPLES,
                                 seed: int = 42, portable: bool = False) -> DataFrame:
    """Seeds drawn per replicate, with fresh rows for every drawn seed slot."""
    by_seed = [*groups, "seed"]
    cells = label_cells(pairs, by_seed)
    sizes = group_sizes(cells, by_seed)
    keys = [*groups, "replicate", "seed_slot"]
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = seed_draws(sizes, groups, samples, seed, portable).join(sizes, by_seed).repartition(width, *keys)
    counts = replicate_cells(reps, cells, by_seed, keys, seed, portable)
    per_slot = label_score_differences(counts.drop("seed"), keys)
    distribution = per_slot.groupBy(*groups, "replicate", "metric").agg(F.avg("value").alias("value"))
    points = label_score_differences(cell_totals(cells, by_seed), by_seed).groupBy(*groups, "metric").agg(F.avg("value").alias("difference"))
    return summarise(distribution, points, [*groups, "metric"], p_smoothing=False)
