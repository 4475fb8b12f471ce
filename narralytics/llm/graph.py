"""Connected components as Spark joins, and the small union step used inside one task."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import written


def local_labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over the given links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps, so the number of rounds grows with the logarithm of
    the longest chain. Minima are aggregated before anything is joined; a node that holds a third of all
    links is a skewed join side, which adaptive execution splits.
    Links with a null end, and links of a node with itself, are ignored. No links give no rows.
    """
    ends = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    current = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        star = (large.join(least, "a")
                .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                          F.struct("a", F.col("low").alias("b")))).alias("e"))
                .select("e.*").where("a <> b").distinct())
        current = written(star, "links")
        after = _state(current)
        if after == state:
            break
        state = after
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
