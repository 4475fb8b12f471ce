"""Ranks over whole tables without sorting a table, or one hot group, in a single task.

A plain ``row_number`` over a global or heavily skewed window runs in one task. Here rows are range-partitioned by
(groups, order) and written once in that order; a row's place in its partition and the sizes of the partitions
before give its rank. A hot group spans as many partitions as its rows fill, and only the small table of
(partition, group) sizes is ever ordered per group.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from narralytics.functions.draws import hash_hex
from narralytics.session import Scratch, stored


def _placed_rank(df: DataFrame, order: Sequence[Column], groups: Sequence[str], out: str) -> DataFrame:
    keys = [*[F.col(g) for g in groups], *order]
    # the ids number the rows of each written partition; written once, so counts and ranks see the same ones
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(groups))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(
        F.min(place).alias("_first"), F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.withColumn("_part", part)
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_p"))
    return placed.join(offsets, same).select(*df.columns, (place - F.col("_first") + F.col("_before") + 1).cast("long").alias(out))


def rank_by_hash(df: DataFrame, keys: Sequence[str], seed, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank in a seeded random order; ``keys`` must identify a row."""
    ordered = df.withColumn("_order", hash_hex(seed, *[F.col(k) for k in keys]))
    return _placed_rank(ordered, [F.col("_order"), *[F.col(k) for k in keys]], groups, out).drop("_order")


def rank_by_value(df: DataFrame, ordinal: str, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank by a unique numeric ordinal."""
    return _placed_rank(df, [F.col(ordinal)], groups, out)


def rank_rows(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank by several columns, which together identify a row."""
    return _placed_rank(df, [F.col(c) for c in order], groups, out)


def first_by_ordinal(df: DataFrame, ordinal: str, rows: int, buckets: int = 4096, small: int = 10_000) -> DataFrame:
    """The rows with the ``rows`` smallest values of a unique numeric ordinal, in no order, on all partitions.

    The last value that belongs to them is found from exact counts: ordinal ranges are counted, the range that
    holds the last row is cut again from its own smallest to its own largest value, until few enough rows are
    left in it to look at. Rows without an ordinal are left out.
    """
    value = F.col(ordinal)
    inside, need = df.where(value.isNotNull()).select(ordinal), rows
    low, high, size = inside.agg(F.min(value), F.max(value), F.count(value)).first()
    if rows <= 0 or not size:
        return df.where(F.lit(False))
    while size > need:
        if size <= small or low == high:
            cut = inside.where(value.between(low, high)).orderBy(ordinal).limit(need).agg(F.max(value)).first()[0]
            return df.where(value <= cut)
        part = F.floor((value.cast("double") - float(low)) / (float(high) - float(low)) * buckets)
        counts = inside.where(value.between(low, high)).groupBy(part.alias("_part")).agg(
            F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        end = F.sum("_n").over(Window.partitionBy().orderBy("_part"))  # at most one row per range
        last = counts.withColumn("_end", end).where(F.col("_end") >= need).orderBy("_part").first()
        need -= last["_end"] - last["_n"]
        low, high, size = last["_low"], last["_high"], last["_n"]
    return df.where(value <= high)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Best k rows of every group. Spark prunes each input partition to k before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


DIGIT_BITS = 16


def _ordered_keys(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, item, key): every value of the columns as a long whose unsigned order is that of the doubles; nulls are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (batch.column("key").to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            keys = np.where(bits < 0, ~bits, bits | np.int64(-1 << 63))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys)], batch.schema.names)

    items = F.array(*[F.struct(F.lit(i).alias("item"), F.col(c).cast("double").alias("key")) for i, c in enumerate(columns)])
    long = df.select(*by, F.explode(items).alias("_e")).select(*by, "_e.item", "_e.key").where("key IS NOT NULL")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:-1]]
    return long.mapInArrow(run, ", ".join([*kinds, "key long"]))


@F.pandas_udf(DoubleType())
def _value_of_key(key: pd.Series) -> pd.Series:
    keys = key.to_numpy(dtype=np.int64)
    return pd.Series(np.where(keys < 0, keys & np.int64((1 << 63) - 1), ~keys).view(np.float64))


def percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, p0, p1, ...): linearly interpolated exact percentiles of whole columns, per group.

    Radix selection: the values become longs in the order of the doubles and are written once. Four passes count, for all
    columns, groups and wanted ranks at once, the next 16 bits of the values that share a wanted rank's bits so far; counts are
    added up per task first, so only counts are shuffled, never values. Groups whose column holds no value have no row.
    """
    scratch, by = Scratch(df.sparkSession), list(by)
    group = [*by, "item"]
    keys = scratch.write(_ordered_keys(df, columns, by), "percentile-keys")
    same = lambda x, y, names: reduce(lambda a, b: a & b, [x[n].eqNullSafe(y[n]) for n in names])
    at = (F.col("_n") - 1) * F.col("_w.p")
    wanted = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for i, p in enumerate(probabilities) for up in (False, True)])
    slots = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", F.explode(wanted)).select(
        *group, F.col("_w.slot").alias("slot"), F.col("_w.up").alias("up"), (at - F.floor(at)).alias("part"),
        F.when(F.col("_w.up"), F.ceil(at)).otherwise(F.floor(at)).cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    slots = scratch.write(slots, "percentile-slots-64")     # two rows per group, column and probability
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        prefix = F.lit(0).cast("long") if shift + DIGIT_BITS == 64 else F.shiftrightunsigned("key", shift + DIGIT_BITS)
        seen = keys.withColumn("prefix", prefix)
        places = slots.select(*group, "prefix").distinct()
        counts = seen.join(places, same(seen, places, [*group, "prefix"]), "left_semi").groupBy(*group, "prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy(*group, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)    # at most 65 536 rows
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        hit = same(slots, counts, [*group, "prefix"]) & (slots["rank"] >= counts["before"]) & (slots["rank"] < counts["before"] + counts["n"])
        found = slots.join(counts, hit).select(*[slots[g] for g in group], "slot", "up", "part", (slots["rank"] - counts["before"]).alias("rank"),
                                               (F.shiftleft(slots["prefix"], DIGIT_BITS) + F.col("digit")).alias("prefix"))
        slots = scratch.write(found, f"percentile-slots-{shift}")
        scratch.drop(f"percentile-slots-{shift + DIGIT_BITS}")
    value = lambda i, up: F.max(F.when((F.col("slot") == i) & (F.col("up") == up), F.col("value")))
    part = lambda i: F.max(F.when(F.col("slot") == i, F.col("part")))
    mixed = [(value(i, False) + F.when((part(i) > 0) & (value(i, False) != value(i, True)), part(i) * (value(i, True) - value(i, False))).otherwise(0.0)).alias(f"p{i}") for i in range(len(probabilities))]
    result = slots.withColumn("value", _value_of_key("prefix")).groupBy(*group).agg(*mixed)
    names = F.array(*[F.lit(c) for c in columns])
    kept = stored(result.select(*by, F.get(names, F.col("item")).alias("column"), *[f"p{i}" for i in range(len(probabilities))]), "percentiles")
    scratch.clear()
    return kept


def exact_percentiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row with linearly interpolated percentiles ``p0, p1, ...`` of a whole column; null where it holds no value."""
    found = percentiles(df, [column], probabilities)
    empty = df.sparkSession.range(1).select(F.lit(column).alias("column"))
    return empty.join(found, "column", "left").select(*[f"p{i}" for i in range(len(probabilities))])
