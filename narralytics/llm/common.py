"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def strings(array: pa.Array) -> list[str]:
    """The values of an Arrow string column, nulls as empty strings."""
    return [x or "" for x in array.to_pylist()]


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty."""
    return [x or b"" for x in array.cast(pa.binary() if array.type == pa.string() else pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int):
    """Smaller record batches, so that what a task builds per batch stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def crc32_mod3(doc_id) -> int | None:
    """Remainder that fixes the held-out third; None for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 3


def unit_draw(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the values only, so a retried task repeats it."""
    mixed = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in columns])
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))
