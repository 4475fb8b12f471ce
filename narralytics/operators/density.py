"""Topics by density: hierarchical clustering of a nearest-neighbour graph, with noise.

A row's core distance is the distance to its ``min_samples``-th nearest other row; two rows are as far apart as the largest of
their distance and their two core distances (mutual reachability). Over the graph of ``min_samples`` neighbours a row, Borůvka rounds of
Spark joins find the minimum spanning forest: every component picks its lightest outgoing edge, pointer jumping names the merged components. The
forest's edges, by weight, are then merged in bands of at most ``BAND_EDGES`` edges, each band in one bounded task. Components below
``min_size`` rows are nothing by themselves: their rows fall into the first component that reaches the size. Where two components of
the size meet, both end as clusters and a parent begins. Of every branch the clusters of largest excess of mass are kept; rows
outside are noise (-1).

All steps are exact for the graph. Distances are those of the unit vectors. Edges are ordered by (weight, smaller id, larger id), so
results do not depend on file layout. Intermediate tables are deleted as soon as the next stands.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narralytics.operators.ranking import rank_rows, top_per_group
from narralytics.operators.similarity import cosine_top_k
from narralytics.session import Scratch, stored

MIN_SAMPLES = 10
MIN_SIZE = 120
BAND_EDGES = 1_000_000
CLOSEST = 1e-9     # shorter distances count as this, so that densities stay finite


def nearest_others(vectors: DataFrame, k: int, **options) -> DataFrame:
    """(id, other, distance, rank): the k nearest other rows of every row of (id, vec), in unit-vector distance."""
    side = vectors.select(F.col("id").cast("long").alias("id"), "vec")
    found = cosine_top_k(side, side, k + 1, **options).where("left_id <> right_id").drop("rank")
    distance = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("similarity")))
    best = top_per_group(found, ["left_id"], [F.round("similarity", 12).desc(), F.col("right_id")], k)
    return best.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), distance.alias("distance"), "rank")


def core_distances(neighbours: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th nearest other row, or to the farthest if there are fewer."""
    return neighbours.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("distance").alias("core"))


def reachability_edges(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: every neighbour pair once, weighted by mutual reachability."""
    own, theirs = cores.withColumnRenamed("core", "core_a"), cores.select(F.col("id").alias("other"), F.col("core").alias("core_b"))
    both = neighbours.join(own, "id").join(theirs, "other")
    weight = F.greatest("distance", "core_a", "core_b", F.lit(CLOSEST))
    return both.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max(weight).alias("w"))


def _roots(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, root) from (label, parent), a forest whose roots are their own parents, by pointer jumping."""
    now, step = scratch.write(hooks, "hooks-0"), 0
    while True:
        up = now.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
        after = scratch.write(now.join(up, "parent").select("label", F.col("above").alias("parent")), f"hooks-{step + 1}")
        moved = after.join(now.withColumnRenamed("parent", "old"), "label").where("parent <> old").limit(1).count()
        scratch.drop(f"hooks-{step}")
        now, step = after, step + 1
        if not moved:
            return now.withColumnRenamed("parent", "root")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning forest of distinct edges (a, b, w), by Borůvka rounds."""
    scratch, step = Scratch(edges.sparkSession), 0
    left = scratch.write(edges.select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")), "forest-edges-0")
    parts: list[DataFrame] = []
    while left.limit(1).count():
        edge = F.struct("w", "a", "b")
        ends = left.select("w", "a", "b", F.explode(F.array(F.struct(F.col("la").alias("label"), F.col("lb").alias("other")),
                                                            F.struct(F.col("lb").alias("label"), F.col("la").alias("other")))).alias("e")).select("w", "a", "b", "e.*")
        # grouped with a partial minimum per task, so a component with most of the edges is one row per task
        picked = scratch.write(ends.groupBy("label").agg(F.min(F.struct(edge.alias("edge"), "other")).alias("p")).select("label", "p.other", "p.edge.*"), f"picked-{step}")
        parts.append(stored(picked.select("a", "b", "w").distinct(), "forest"))
        back = picked.select(F.col("label").alias("other"), F.col("other").alias("theirs"))
        mutual = (F.col("theirs") == F.col("label")) & (F.col("label") < F.col("other"))
        hooks = picked.join(back, "other").select("label", F.when(mutual, F.col("label")).otherwise(F.col("other")).alias("parent"))
        inner = Scratch(edges.sparkSession)
        roots = _roots(hooks, inner)
        named = lambda c: roots.select(F.col("label").alias(c), F.col("root").alias(f"{c}_root"))
        merged = left.join(named("la"), "la").join(named("lb"), "lb").where("la_root <> lb_root").select(
            "a", "b", "w", F.col("la_root").alias("la"), F.col("lb_root").alias("lb"))
        left = scratch.write(merged, f"forest-edges-{step + 1}")
        scratch.drop(f"forest-edges-{step}", f"picked-{step}")
        inner.clear()
        step += 1
    scratch.clear()
    forest = edges.select("a", "b", "w").limit(0)
    for part in parts:       # one per round: at most the logarithm of the rows
        forest = forest.unionByName(part)
    return forest


class _Condenser:
    """Merges a band's edges in order; keeps size, cluster and mass per component it touches."""

    def __init__(self, min_size: int) -> None:
        self.min_size = min_size
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.state: dict[int, tuple[int, float, float]] = {}     # root -> cluster, sum of densities, best mass of its children
        self.joined: dict[int, int] = {}                         # small label at the start of the band -> cluster
        self.members: dict[int, list[int]] = {}                  # small root -> such labels
        self.clusters: list[tuple[int, int, bool, int]] = []     # cluster, parent cluster, kept, rows

    def add(self, label: int, size: int, cluster, mass, best) -> None:
        if label in self.parent:
            return
        self.parent[label], self.size[label] = label, size
        if cluster is None:
            self.members[label] = [label]
        else:
            self.state[label] = (cluster, mass, best)

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def end(self, root: int, density: float, parent: int) -> float:
        """Closes a cluster that begins (seen from the root of the tree) at this density; the best mass of its branch."""
        cluster, mass, best = self.state.pop(root)
        own = mass - self.size[root] * density
        self.clusters.append((cluster, parent, own >= best, self.size[root]))
        return max(own, best)

    def _fall(self, root: int, cluster: int) -> None:
        for label in self.members.pop(root):
            self.joined[label] = cluster

    def merge(self, a: int, b: int, w: float, name: int) -> None:
        x, y = self.find(a), self.find(b)
        density = 1.0 / w
        big = [r for r in (x, y) if r in self.state]
        total = self.size[x] + self.size[y]
        if len(big) == 2:
            state = (name, total * density, sum(self.end(r, density, name) for r in (x, y)))
        elif len(big) == 1:
            cluster, mass, best = self.state.pop(big[0])
            small = y if big[0] == x else x
            state = (cluster, mass + self.size[small] * density, best)
            self._fall(small, cluster)
        elif total >= self.min_size:
            state = (name, total * density, 0.0)
            self._fall(x, name), self._fall(y, name)
        else:
            state = None
        keep, gone = (x, y) if self.size[x] >= self.size[y] else (y, x)
        self.parent[gone], self.size[keep] = keep, total
        if state:
            self.state[keep] = state
        else:
            self.members[keep].extend(self.members.pop(gone))


_BAND = "kind string, label long, root long, cluster long, size long, mass double, best double, kept boolean"


def _condensed_band(edges: DataFrame, states: DataFrame, min_size: int) -> DataFrame:
    """One task over one band: moved labels, states of the roots and clusters that ended."""
    def run(_, pdf: pd.DataFrame) -> pd.DataFrame:
        work = _Condenser(min_size)
        for label, size, cluster, mass, best in pdf.loc[pdf.kind == "state", ["label", "size", "cluster", "mass", "best"]].itertuples(index=False):
            work.add(int(label), int(size), None if pd.isna(cluster) else int(cluster), mass, best)
        rows = pdf[pdf.kind == "edge"].sort_values("place")
        for a, b, w, place in rows[["a", "b", "w", "place"]].itertuples(index=False):
            work.add(int(a), 1, None, 0.0, 0.0), work.add(int(b), 1, None, 0.0, 0.0)
            work.merge(int(a), int(b), w, int(place))
        out = [("moved", x, work.find(x), work.joined.get(x), None, None, None, None) for x in work.parent]
        for root in (x for x in work.parent if work.parent[x] == x):
            cluster, mass, best = work.state.get(root, (None, 0.0, 0.0))
            out.append(("state", root, root, cluster, work.size[root], mass, best, None))
        out += [("ended", parent, None, cluster, size, None, None, kept) for cluster, parent, kept, size in work.clusters]
        frame = pd.DataFrame(out, columns=["kind", "label", "root", "cluster", "size", "mass", "best", "kept"])
        return frame.astype({c: "Int64" for c in ("label", "root", "cluster", "size")} | {"kept": "boolean"})

    none = lambda kind: F.lit(None).cast(kind)
    both = edges.select(F.lit("edge").alias("kind"), none("long").alias("label"), none("long").alias("size"), none("long").alias("cluster"),
                        none("double").alias("mass"), none("double").alias("best"), F.col("la").alias("a"), F.col("lb").alias("b"), "w", "place").unionByName(
        states.select(F.lit("state").alias("kind"), "label", "size", "cluster", "mass", "best", none("long").alias("a"), none("long").alias("b"),
                      none("double").alias("w"), none("long").alias("place")))
    return both.groupBy(F.lit(0).alias("band")).applyInPandas(lambda key, pdf: run(key, pdf), _BAND)


def condense(nodes: DataFrame, forest: DataFrame, min_size: int = MIN_SIZE, band_edges: int = BAND_EDGES, allow_single: bool = False) -> DataFrame:
    """(id, cluster) of every node (id); cluster is null for noise, else the number of the edge that made it.

    A tree of the forest that never splits is one cluster only with ``allow_single`` or if the forest has more than one tree.
    """
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession)
    ranked = scratch.write(rank_rows(forest.select("a", "b", "w"), ["w", "a", "b"], out="place"), "forest-ranked")
    bands = -(-ranked.count() // band_edges)
    at = scratch.write(nodes.select("id", F.col("id").alias("label"), F.lit(None).cast("long").alias("cluster")), "nodes-0")
    left = scratch.write(ranked.select("a", "b", "w", "place", F.col("a").alias("la"), F.col("b").alias("lb")), "band-edges-0")
    states = spark.createDataFrame([], "label long, size long, cluster long, mass double, best double")
    ended: list[DataFrame] = []
    for band in range(bands):
        mine = F.col("place") <= (band + 1) * band_edges
        now = left.where(mine)
        touched = now.select(F.explode(F.array("la", "lb")).alias("label")).distinct()
        done = scratch.write(_condensed_band(now, states.join(touched, "label", "left_semi"), min_size), f"band-{band}")
        moves = done.where("kind = 'moved'").select("label", "root", F.col("cluster").alias("joined"))
        fresh = done.where("kind = 'state'").select("label", "size", "cluster", "mass", "best")
        kept_states = scratch.write(states.join(touched, "label", "left_anti").unionByName(fresh), f"states-{band}")
        ended.append(done.where("kind = 'ended'").select("cluster", F.col("label").alias("parent"), "kept", "size"))
        after = scratch.write(at.join(moves, "label", "left").select(
            "id", F.coalesce("root", "label").alias("label"), F.coalesce("cluster", "joined").alias("cluster")), f"nodes-{band + 1}")
        named = lambda c: moves.select(F.col("label").alias(c), F.col("root").alias(f"{c}_root"))
        rest = left.where(~mine).join(named("la"), "la", "left").join(named("lb"), "lb", "left").select(
            "a", "b", "w", "place", F.coalesce("la_root", "la").alias("la"), F.coalesce("lb_root", "lb").alias("lb"))
        left, at, states = scratch.write(rest, f"band-edges-{band + 1}"), after, kept_states
        scratch.drop(f"nodes-{band}", f"band-edges-{band}", *([f"states-{band - 1}"] if band else []))
    # trees that are left: their last cluster begins at density 0
    trees = at.select("label").distinct().limit(2).count()
    own = F.col("mass") >= F.col("best")
    last = states.where("cluster IS NOT NULL").select("cluster", F.lit(None).cast("long").alias("parent"),
                                                      (own if allow_single or trees > 1 else F.lit(False)).alias("kept"), "size")
    tree = last
    for part in ended:
        tree = tree.unionByName(part)
    tops = _topmost(scratch.write(tree, "clusters"), scratch)
    found = stored(at.select("id", "cluster").join(tops, "cluster", "left").select("id", F.col("top").alias("cluster")), "density-clusters")
    scratch.clear()
    return found


def _topmost(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster, top): the kept cluster nearest the root on the way from each cluster up, null if none is kept."""
    now = scratch.write(tree.select("cluster", F.when(F.col("kept"), F.col("cluster")).alias("top"), F.col("parent").alias("above")), "tops-0")
    step = 0
    while now.where("above IS NOT NULL").limit(1).count():
        up = now.select(F.col("cluster").alias("above"), F.col("top").alias("higher"), F.col("above").alias("next"))
        after = scratch.write(now.join(up, "above", "left").select("cluster", F.coalesce("higher", "top").alias("top"), F.col("next").alias("above")), f"tops-{step + 1}")
        scratch.drop(f"tops-{step}")
        now, step = after, step + 1
    return now.select("cluster", "top")


def density_topics(vectors: DataFrame, min_samples: int = MIN_SAMPLES, min_size: int = MIN_SIZE, band_edges: int = BAND_EDGES,
                   allow_single: bool = False, out: str = "topic_id") -> DataFrame:
    """(id, topic) of every row of (id, vec): topics from 0 by falling size, -1 for noise. Ids are unique."""
    neighbours = stored(nearest_others(vectors, min_samples), "neighbours")
    edges = stored(reachability_edges(neighbours, core_distances(neighbours, min_samples)), "reachability")
    nodes = vectors.select(F.col("id").cast("long").alias("id"))
    found = condense(nodes, spanning_forest(edges), min_size, band_edges, allow_single)
    sizes = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = sizes.withColumn(out, (F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "first")) - 1).cast("int"))  # one row per topic
    return found.join(order.select("cluster", out), "cluster", "left").select("id", F.coalesce(out, F.lit(-1)).alias(out))
