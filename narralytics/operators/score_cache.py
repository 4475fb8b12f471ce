"""A stored score cache laid out by the first digits of its keys.

Keys are hexadecimal digests, so their first digits deal rows out evenly. The table is a folder of generations, each with one folder per prefix; every prefix
lives in one finished generation. A lookup reads only the prefixes of its keys, an append rewrites only the prefixes it touches and
settles repeated keys while it writes, so every key has one row. A generation counts once it is finished, and only then are the
folders it replaces deleted; an append that dies changes nothing. One writer at a time.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.session import remove_path, stored


class ScoreCache:
    """``schema`` are the columns beside the key, as a DDL string."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "cache_key", digits: int = 2) -> None:
        self.spark, self.path, self.schema, self.key, self.digits = spark, path.rstrip("/"), f"{key} string, {schema}", key, digits
        self.others = [f.name for f in spark.createDataFrame([], schema).schema]

    def _folders(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []

    def places(self) -> dict[str, str]:
        """The folder of every prefix: that of the newest finished generation which has it. At most 16**digits entries."""
        found = {}
        for generation in self._folders(self.path):
            names = self._folders(f"{self.path}/{generation}")
            if "_SUCCESS" in names:
                found |= {n.removeprefix("prefix="): f"{self.path}/{generation}/{n}" for n in names if n.startswith("prefix=")}
        return found

    def _prefix(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prefix", F.substring(self.key, 1, self.digits))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, prefixes: list[str] | None = None) -> DataFrame:
        """The cached rows, of some prefixes only if they are given."""
        places = self.places()
        return self._read([places[p] for p in (places if prefixes is None else prefixes) if p in places])

    def _touched(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in self._prefix(rows.where(F.col(self.key).isNotNull())).select("prefix").distinct().collect())

    def lookup(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with their scores, misses); only the prefixes of the keys in ``rows`` are read."""
        cached = self.read(self._touched(rows))
        return rows.join(cached, self.key), rows.join(cached.select(self.key), self.key, "left_anti")

    def append(self, scores: DataFrame) -> None:
        """Adds rows (key, scores). The row that is in the cache already stays; of new rows with one key the smallest counts."""
        new = stored(scores.select(self.key, *self.others), "cache-append")
        touched, places = self._touched(new), self.places()
        if not touched:
            return
        replaced = [places[p] for p in touched if p in places]
        both = self._read(replaced).withColumn("_new", F.lit(0)).unionByName(new.where(F.col(self.key).isNotNull()).withColumn("_new", F.lit(1)))
        once = both.groupBy(self.key).agg(F.min(F.struct("_new", *self.others)).alias("_s")).select(self.key, *[F.col(f"_s.{c}").alias(c) for c in self.others])
        generations = self._folders(self.path)
        target = f"{self.path}/g={int(generations[-1][2:]) + 1 if generations else 0:012d}"
        self._prefix(once).repartition("prefix").write.partitionBy("prefix").parquet(target)
        for folder in replaced:
            remove_path(self.spark, folder)


def score_with_stored_cache(rows: DataFrame, cache: ScoreCache, score) -> DataFrame:
    """Hits from the cache, misses through ``score`` (a DataFrame function that adds the cache columns); new scores are kept in the cache."""
    hits, misses = cache.lookup(rows)
    found = stored(hits, "cache-hits")      # before the append replaces what it reads
    new = stored(score(misses).select(*found.columns), "new-scores")
    cache.append(new)
    return found.unionByName(new)
