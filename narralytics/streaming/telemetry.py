"""Windowed telemetry rollup over an append-only log."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from narralytics.operators.runs import telemetry_rollup


def windowed_rollup(records: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Rollup per tumbling window and phase; rows later than the watermark are dropped on a stream."""
    watched = records.withWatermark(ts, delay) if records.isStreaming else records
    grouped = telemetry_rollup(watched.withColumn("_w", F.window(ts, window)), ["_w", "phase"])
    return grouped.withColumn("window_start", F.col("_w.start")).drop("_w")


def rollup_stream(records: DataFrame, out: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes") -> DataStreamWriter:
    """Upserts of every micro-batch under ``out``, one folder per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (windowed_rollup(records, window, delay).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def latest_windows(upserts: DataFrame) -> DataFrame:
    """Final state of every window: the row of its last batch."""
    values = [c for c in upserts.columns if c not in ("window_start", "phase", "batch")]
    return upserts.groupBy("window_start", "phase").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("window_start", "phase", "v.*")
