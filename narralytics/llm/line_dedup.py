"""Line deduplication that can be taken back: sharded cuckoo filters over exact reference-count tables.

A line's key is the stripped, A-Z lower-cased line; keys of ``min_chars`` code points or more are counted by the documents that hold them. The
index keeps three kinds of written tables, all append-only:

* references (key, doc_id, gen, live): the exact record of which document holds which key; a deletion appends rows with ``live`` false;
* counts (key, n, last, gen): exact reference count and largest doc_id per key; of several rows of a key the one of the newest generation holds;
* one cuckoo filter per shard of the keys (16-bit fingerprints, four slots a bucket, in parts of bounded size) of all keys with a reference.

An insertion asks the filters first: a key that they do not hold is new, so its count is that of the batch, without a look at the tables. Only keys that may be
present are counted again from their references. A deletion counts the keys of the deleted documents again and takes keys without a reference out of the
filters, so the filters shrink again, and inserting and then deleting documents leaves every count, and so every decision, as before. Keys are aggregated
before they are joined or dealt to shards, so a line that stands in a third of all documents is one row there; the join of references with frequent keys is
salted. Shards are as many as the counted keys need; when a batch outgrows them, filters are rebuilt with more.

A key in ``min_docs`` documents or more loses its lines in all of them but the one of largest doc_id. Decisions go to the documents as
lists of keys; only that step moves texts.

Defined results: a null or empty text has one empty line. Rows of one doc_id are one document when lines are counted and lose the same keys; each row is returned. Rows with
a null doc_id count for nothing and keep all lines. Inserting a document again adds what is new in it. Deleting an unknown document does nothing. An empty
table gives an empty result. Keys are told apart by 128 bits of XXH64, within one document by 64. Further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.llm.common import strings, text_or_empty
from narralytics.session import Scratch, scratch_path, small_side, spread

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 14      # keys a shard is made for
PART_BUCKETS = 1 << 16    # buckets of one part of a filter at most: 512 KB
SLOTS, LOAD, KICKS = 4, 0.9, 200
SALTS = 16
KEY = ["k1", "k2"]
REFS = "k1 long, k2 long, doc_id long, gen int, live boolean"
COUNTS = "k1 long, k2 long, n long, last long, gen int"
FILTERS = "shard long, part int, cells binary"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in small letters."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)    # ASCII only: the fast function does the same
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def key_hash(line: Column, min_chars: int) -> Column:
    """(k1, k2) of a line, null when its key is too short."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")))


# --- cuckoo filters -----------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prints(k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and unreduced bucket hash of keys."""
    h = _mixed(k1.view(np.uint64))
    return (h >> np.uint64(48)).astype(np.uint16) % np.uint16(65535) + np.uint16(1), h & np.uint64(0xFFFFFFFF)


class Cuckoo:
    """One part of a filter: ``cells`` has a row of slots per bucket, 0 for a free slot."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        self.mask = np.uint64(len(cells) - 1)

    @staticmethod
    def sized(keys: int) -> "Cuckoo":
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return Cuckoo(np.zeros((min(buckets, PART_BUCKETS), SLOTS), dtype=np.uint16))

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (_mixed(fp) & self.mask)

    def room(self) -> int:
        return int(self.cells.size * LOAD) - int(np.count_nonzero(self.cells))

    def holds(self, fp: np.ndarray, h: np.ndarray) -> np.ndarray:
        first = h & self.mask
        return (self.cells[first] == fp[:, None]).any(axis=1) | (self.cells[self.other(first, fp)] == fp[:, None]).any(axis=1)

    def _put(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fills free slots of the buckets; True where an item found none."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        starts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        free = np.argsort(self.cells[at] != 0, axis=1, kind="stable")     # free slots first
        fits = nth < SLOTS - np.count_nonzero(self.cells[at], axis=1)
        rows = np.flatnonzero(fits)
        self.cells[at[rows], free[rows, nth[rows]]] = fp[order[rows]]
        left = np.ones(len(fp), dtype=bool)
        left[order[rows]] = False
        return left

    def add(self, fp: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inserts items; returns what found no place after ``KICKS`` rounds, as (fingerprint, bucket in this part)."""
        bucket = h & self.mask
        rng = np.random.default_rng(len(fp))
        for _ in range(KICKS):
            if not len(fp):
                break
            left = self._put(fp, bucket)
            fp, bucket = fp[left], self.other(bucket[left], fp[left])
            if not len(fp):
                break
            left = self._put(fp, bucket)
            fp, bucket = fp[left], bucket[left]
            _, one = np.unique(bucket, return_index=True)    # one item per bucket takes the place of another
            slot = rng.integers(0, SLOTS, len(one))
            out = self.cells[bucket[one], slot].copy()
            self.cells[bucket[one], slot] = fp[one]
            fp = fp.copy()
            fp[one] = out
            bucket = self.other(bucket, fp)
        return fp, bucket

    def remove(self, fp: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Clears one slot per item; True where the item was not here. Items must have been inserted."""
        missing = np.ones(len(fp), dtype=bool)
        first = h & self.mask
        for bucket in (first, self.other(first, fp)):
            todo = np.flatnonzero(missing)
            while len(todo):
                _, one = np.unique(bucket[todo] * np.uint64(65536) + fp[todo], return_index=True)
                rows = todo[one]                               # of equal items one a round
                hit = self.cells[bucket[rows]] == fp[rows, None]
                found = hit.any(axis=1)
                self.cells[bucket[rows[found]], hit[found].argmax(axis=1)] = 0
                missing[rows[found]] = False
                todo = np.setdiff1d(todo, rows)
        return missing


class Filter:
    """The parts of one shard; a part that is full stays and another is opened."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts = [Cuckoo(np.frombuffer(p, dtype=np.uint16).reshape(-1, SLOTS).copy()) for p in parts]

    def holds(self, k1: np.ndarray) -> np.ndarray:
        fp, h = prints(k1)
        seen = np.zeros(len(k1), dtype=bool)
        for part in self.parts:
            seen |= part.holds(fp, h)
        return seen

    def add(self, k1: np.ndarray) -> None:
        fp, h = prints(k1)
        while len(fp):
            if not self.parts or self.parts[-1].room() <= 0:
                self.parts.append(Cuckoo.sized(len(fp)))
            part = self.parts[-1]
            n = max(1, min(len(fp), part.room()))
            spilled, bucket = part.add(fp[:n], h[:n])
            fp, h = fp[n:], h[n:]
            while len(spilled):       # found no place: into a further part of the same size, where their buckets are the same
                own = Cuckoo(np.zeros((len(part.cells), SLOTS), dtype=np.uint16))
                self.parts.append(own)
                spilled, bucket = own.add(spilled, bucket)

    def remove(self, k1: np.ndarray) -> None:
        fp, h = prints(k1)
        for part in reversed(self.parts):
            missing = part.remove(fp, h)
            fp, h = fp[missing], h[missing]
            if not len(fp):
                return

    def blobs(self) -> list[bytes]:
        return [p.cells.tobytes() for p in self.parts if p.cells.any()]


_EVENT = pa.schema([("shard", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("seen", pa.bool_()), ("part", pa.int32()), ("cells", pa.binary())])


def _filtered(keys: DataFrame, filters: DataFrame, shards: int, insert: bool) -> DataFrame:
    """The keys with ``seen`` (held by the filters so far) and, as rows with ``part``, the filters after this step.

    An insertion adds the keys that were not seen, unless the table says ``sure``; a removal takes every key out.
    """
    def meet(key: tuple, rows: pa.Table, parts: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        held = Filter([c for _, c in sorted(zip(parts.column("part").to_pylist(), parts.column("cells").to_pylist()))])
        k1 = rows.column("k1").to_numpy()
        seen = held.holds(k1)
        if insert:
            held.add(k1[~seen | rows.column("sure").to_numpy(zero_copy_only=False).astype(bool)])
        else:
            held.remove(k1)
        blobs = held.blobs()
        events = pa.Table.from_arrays([pa.array(np.full(len(k1), shard, dtype=np.int64)), rows.column("k1"), rows.column("k2"), pa.array(seen),
                                       pa.nulls(len(k1), pa.int32()), pa.nulls(len(k1), pa.binary())], schema=_EVENT)
        none = pa.nulls(len(blobs), pa.int64())
        state = pa.Table.from_arrays([pa.array([shard] * len(blobs), pa.int64()), none, none, pa.nulls(len(blobs), pa.bool_()),
                                      pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], schema=_EVENT)
        return pa.concat_tables([events, state])

    dealt = spread(keys.withColumn("shard", F.pmod("k2", F.lit(shards))), "shard")
    return dealt.groupBy("shard").cogroup(spread(filters, "shard").groupBy("shard")).applyInArrow(
        meet, "shard long, k1 long, k2 long, seen boolean, part int, cells binary")


# --- the index ----------------------------------------------------------------------------------------------

class LineIndex:
    """References, counts and filters of the lines of a changing set of documents, under one folder.

    Every step writes new tables and then one row of ``meta`` that names them; a step that dies before leaves the index as it was.
    """

    META = "gen int, shards long, keys long, refs array<string>, counts array<string>, filters string"

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "line-index")
        self.min_chars, self.min_docs, self.shard_keys = min_chars, min_docs, shard_keys
        self.gen, self.shards, self.keys, self.refs, self.counts, self.filters = 0, 1, 0, [], [], None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> "LineIndex":
        """The index as the last finished step left it."""
        index = cls(spark, path, **options)
        last = spark.read.schema(cls.META).parquet(f"{path}/meta").orderBy(F.desc("gen")).first()
        index.gen, index.shards, index.keys, index.refs, index.counts, index.filters = last
        return index

    def _add(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}-{self.gen + 1}-{scratch_path(self.spark, kind)[-32:]}"
        df.write.parquet(path)
        return path

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, refs: list[str], counts: list[str], filters: str, keys: int) -> None:
        self.gen, self.refs, self.counts, self.filters, self.keys = self.gen + 1, refs, counts, filters, keys
        row = [(self.gen, self.shards, self.keys, self.refs, self.counts, self.filters)]
        self.spark.createDataFrame(row, self.META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def references(self) -> DataFrame:
        """(k1, k2, doc_id): which document holds which key now."""
        rows = self._read(REFS, self.refs)
        if len(self.refs) < 2:      # the first step writes each pair once
            return rows.select(*KEY, "doc_id")
        return rows.groupBy(*KEY, "doc_id").agg(F.max_by("live", "gen").alias("live")).where("live").select(*KEY, "doc_id")

    def reference_counts(self) -> DataFrame:
        """(k1, k2, n, last): documents per key and the largest of them; keys without a document are left out."""
        rows = self._read(COUNTS, self.counts)
        if len(self.counts) > 1:
            rows = rows.groupBy(*KEY).agg(F.max_by(F.struct("n", "last"), "gen").alias("c")).select(*KEY, "c.*")
        return rows.where("n > 0").select(*KEY, "n", "last")

    def pairs(self, docs: DataFrame) -> DataFrame:
        """(k1, k2, doc_id) of the keys of documents with an id, each once."""
        keys = F.array_distinct(F.filter(F.transform(lines(text_or_empty()), lambda x: key_hash(x, self.min_chars)), lambda k: k.isNotNull()))
        return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(keys)).select(*KEY, "doc_id").distinct()

    def _recount(self, keys: DataFrame, references: DataFrame) -> DataFrame:
        """(k1, k2, n, last) of the given keys, n 0 where no document holds them any more."""
        held = references.join(small_side(keys.select(*KEY)), KEY, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        return keys.select(*KEY).join(held, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "last")

    def _resharded(self, keys: int, scratch: Scratch) -> DataFrame:
        """The filters, dealt to more shards when these keys outgrow the present ones."""
        filters = self._read(FILTERS, [self.filters] if self.filters else [])
        wanted = max(1, -(-(self.keys + keys) // self.shard_keys))
        if wanted <= 4 * self.shards and self.filters:
            return filters
        self.shards = wanted
        if not self.filters:
            return filters
        none = self.spark.createDataFrame([], FILTERS)
        held = self.reference_counts().select(*KEY, F.lit(True).alias("sure"))
        return scratch.write(_filtered(held, none, self.shards, True).where("part IS NOT NULL").select("shard", "part", "cells"), "line-filters")

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Adds the lines of ``docs`` (doc_id, text)."""
        scratch, gen = Scratch(self.spark), F.lit(self.gen + 1)
        before, first = self.references(), not self.refs
        pairs = self.pairs(docs)
        refs = self._add(pairs.select(*KEY, "doc_id", gen.alias("gen"), F.lit(True).alias("live")), "refs")
        batch = self._read(REFS, [refs]).select(*KEY, "doc_id")
        keys = scratch.write(batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "line-keys")
        filters = self._resharded(keys.count(), scratch)
        stepped = scratch.write(_filtered(keys.select(*KEY, F.lit(False).alias("sure")), filters, self.shards, True), "line-step")
        state = stepped.where("part IS NOT NULL").select("shard", "part", "cells")
        seen = stepped.where("seen").select(*KEY)
        new = keys
        if not first:
            new = keys.join(seen, KEY, "left_anti")
            known = scratch.write(self._recount(seen, before).withColumnRenamed("n", "old"), "line-known")
            again = scratch.write(self._recount(seen, before.unionByName(batch).distinct()), "line-recounted")
            doubted = known.where("old = 0").select(*KEY, F.lit(True).alias("sure"))    # the filter was wrong: these are new as well
            if not doubted.isEmpty():
                state = _filtered(doubted, state, self.shards, True).where("part IS NOT NULL").select("shard", "part", "cells")
            new = new.select(*KEY, "n", "last").unionByName(again)
        counts = self._add(new.select(*KEY, "n", "last", gen.alias("gen")), "counts")
        written = self._add(state, "filters")
        fresh = keys.count() if first else keys.count() - known.where("old > 0").count()
        self._commit([*self.refs, refs], [*self.counts, counts], written, self.keys + fresh)
        scratch.clear()
        return self

    def delete(self, ids: DataFrame) -> "LineIndex":
        """Takes the documents of the ids (doc_id) out again."""
        scratch, gen = Scratch(self.spark), F.lit(self.gen + 1)
        chosen = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        now = self.references()
        gone = scratch.write(now.join(chosen, "doc_id", "left_semi").select(*KEY, "doc_id"), "line-gone")
        refs = self._add(gone.select(*KEY, "doc_id", gen.alias("gen"), F.lit(False).alias("live")), "refs")
        keys = scratch.write(gone.select(*KEY).distinct(), "line-keys")
        again = scratch.write(self._recount(keys, now.join(chosen, "doc_id", "left_anti")), "line-recounted")
        counts = self._add(again.select(*KEY, "n", "last", gen.alias("gen")), "counts")
        empty = again.where("n = 0").select(*KEY)
        filters = self._read(FILTERS, [self.filters] if self.filters else [])
        written = self._add(_filtered(empty, filters, self.shards, False).where("part IS NOT NULL").select("shard", "part", "cells"), "filters")
        self._commit([*self.refs, refs], [*self.counts, counts], written, self.keys - empty.count())
        scratch.clear()
        return self

    def dropped_keys(self) -> DataFrame:
        """(doc_id, drops): per document the first halves of the keys whose lines go."""
        frequent = self.reference_counts().where(F.col("n") >= self.min_docs).select(*KEY, "last")
        refs, on = self.references(), [*KEY, "salt"]
        few = frequent.limit(100_001).count() <= 100_000      # a plan choice only
        salt = F.lit(0) if few else F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        frequent = frequent.withColumn("salt", salt)
        salted = refs.withColumn("salt", F.lit(0) if few else F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        hits = salted.join(F.broadcast(frequent) if few else frequent, on).where("doc_id <> last")
        return hits.groupBy("doc_id").agg(F.collect_set("k1").alias("drops"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, kept (text), n_lines, n_dropped of every row of ``docs``; documents outside the index keep all lines."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(
            self.dropped_keys().withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
        minimum = self.min_chars
        keyed = rows.withColumn("keys", F.when(F.col("drops").isNotNull(), F.transform(lines(F.col("text")), lambda x: key_hash(x, minimum)["k1"])))

        def run(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    kept, sizes, gone = [], [], []
                    for text, keys, drops in zip(strings(batch.column("text")), batch.column("keys"), batch.column("drops")):
                        parts, n = text.split("\n"), 0
                        if drops.is_valid:
                            lost = set(drops.values.to_pylist())
                            stay = [x for x, k in zip(parts, keys.values.to_pylist()) if k is None or k not in lost]
                            n = len(parts) - len(stay)
                            text = "\n".join(stay)
                        kept.append(text), sizes.append(len(parts)), gone.append(n)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
                                                     ["doc_id", "kept", "n_lines", "n_dropped"])

        return keyed.select("doc_id", "text", "keys", "drops").mapInArrow(run, "doc_id long, kept string, n_lines long, n_dropped long")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: every row of ``docs`` after line deduplication over all of them."""
    index = LineIndex(docs.sparkSession, **options).insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
