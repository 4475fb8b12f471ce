"""Streamed narrative filter with an exactly-once file sink."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from narralytics.constants import FIRST_PERSON_THRESHOLD, PAST_THRESHOLD
from narralytics.operators.corpus import narrative_filter
from narralytics.operators.ranking import first_by_ordinal
from narralytics.session import spread


def filter_stream(stream: DataFrame, out: str, checkpoint: str, ordinal: str, max_rows: int | None = None, tagger=None,
                  past: float = PAST_THRESHOLD, first_person: float = FIRST_PERSON_THRESHOLD) -> DataStreamWriter:
    """Writes the narrative rows of every micro-batch to ``out/kept``; reads every row, or the first ``max_rows``.

    A batch replaces its own folder, so a batch that is run again after a failure leaves one copy.
    The rows read by earlier batches are counted from ``out/read``, which survives restarts.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if max_rows is not None:
            done = 0
            if batch_id > 0:
                log = batch.sparkSession.read.schema("rows long, batch long").parquet(f"{out}/read")
                done = log.where(f"batch < {batch_id}").groupBy().sum("rows").first()[0] or 0
            left = max(0, max_rows - done)
            size = batch.count()
            rows = batch if size <= left else first_by_ordinal(batch, ordinal, left)
            batch.sparkSession.range(1).selectExpr(f"cast({min(size, left)} as long) rows").write.mode("overwrite").parquet(f"{out}/read/batch={batch_id}")
        # a batch has a task per file; tagging is spread over the cores
        kept = narrative_filter(spread(rows, ordinal), tagger=tagger, past=past, first_person=first_person)
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
