"""Session construction and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "narralytics") -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own session."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NARRALYTICS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="narralytics-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/narralytics/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write once to the shared scratch folder and read back; later actions never run ``df`` again."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_GROUPS = {"parquet.block.size": 8 << 20}  # for tables that are read in small splits: a row group is never divided


@contextmanager
def small_splits(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """What is run inside reads files in splits of at most ``size`` bytes.

    For steps whose cost is CPU, not bytes: with larger splits a few long tasks would end long after the others.
    """
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > size:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables of one run in the shared folder, each deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once and read back; a name that is used again must have been dropped before."""
        if name in self.paths:
            raise ValueError(f"scratch table {name} is still in use")
        path = self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, self.paths.pop(name))

    def clear(self) -> None:
        self.drop(*self.paths)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system that Spark itself uses for it; a missing one is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every scratch table this library has left in the shared folder.

    For the end of an application: results that have not been written elsewhere can no longer be read.
    """
    remove_path(spark, f"{shared_dir(spark).rstrip('/')}/narralytics")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcasting when it has at most ``rows`` rows; the join's result is the same either way."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose values are computed once a row: a plain column is computed again by every filter that names it."""
    row = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    made = df.select("*", row.alias("_once"))
    return made.select(*[F.col(f"_once.{c}").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns],
                       *[F.col(f"_once.{c}").alias(c) for c in columns if c not in df.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key with a fixed partition count.

    Used before steps whose cost is CPU, not bytes: adaptive execution would merge such partitions
    by their byte size and leave cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
