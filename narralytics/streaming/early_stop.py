"""Stop decisions over a stream of validations, with keyed state per run."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = ("best_step long, best_loss double, latest_step long, latest_loss double, validations_without_improvement long, "
            "relative_degradation double, reason string")


def decide(history: dict[int, float], patience: int, degradation: float) -> tuple:
    """The row of ``DECISION`` for the losses by step; the best step is the first minimum."""
    best = min(history, key=lambda s: (history[s], s))
    latest = max(history)
    later = sum(s > best for s in history)
    relative = history[latest] / history[best] - 1.0
    reason = None
    if latest != best and relative >= degradation:
        reason = "immediate_relative_degradation_threshold"
    elif later >= patience:
        reason = "validation_patience_exhausted"
    return best, history[best], latest, history[latest], later, relative, reason


class StopMonitor(StatefulProcessor):
    """Keeps the losses of a run by step, so late and corrected validations count as in the batch form.

    Every trigger emits the decision of the runs that it changed; with ``once`` only the first one that stops a run.
    The state of a run grows with its validations; it is one value, read once and written once a trigger, whatever the number of steps.
    """

    def __init__(self, key: str, kind: str, patience: int, degradation: float, once: bool) -> None:
        self.key, self.kind, self.patience, self.degradation, self.once = key, kind, patience, degradation, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.losses = handle.getValueState("losses", "steps array<bigint>, eval_losses array<double>")
        self.stopped = handle.getValueState("stopped", "reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.once and self.stopped.exists():
            for _ in rows:
                pass
            return
        known = self.losses.get()
        history = {} if known is None else dict(zip(*known))
        for pdf in rows:
            history.update(zip(pdf["step"].astype(int).tolist(), pdf["eval_loss"].astype(float).tolist()))
        self.losses.update((list(history), list(history.values())))
        row = decide(history, self.patience, self.degradation)
        if self.once and row[-1] is None:
            return
        if row[-1] is not None:
            self.stopped.update((row[-1],))
        yield pd.DataFrame([(key[0], *row)], columns=[self.key, *[c.split()[0] for c in DECISION.split(", ")]])

    def close(self) -> None:
        pass


def stop_decisions(history: DataFrame, key: str = "run", patience: int = 2, degradation: float = 0.10, once: bool = False) -> DataFrame:
    """Streamed form of ``early_stop`` over (key, step, eval_loss)."""
    kind = dict(history.dtypes)[key]
    history.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)     # keyed state needs it
    return history.select(key, "step", "eval_loss").groupBy(key).transformWithStateInPandas(
        StopMonitor(key, kind, patience, degradation, once), outputStructType=f"{key} {kind}, {DECISION}", outputMode="Update", timeMode="None")


def stop_stream(history: DataFrame, out: str, checkpoint: str, key: str = "run", **options) -> DataStreamWriter:
    """Decisions of every micro-batch under ``out``, one folder per batch; a batch that runs again replaces its folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stop_decisions(history, key, **options).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def latest_decisions(decisions: DataFrame, key: str = "run") -> DataFrame:
    """The decision of every run's last batch."""
    values = [c for c in decisions.columns if c not in (key, "batch")]
    return decisions.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("d")).select(key, "d.*")
