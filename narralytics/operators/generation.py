"""Row-wise generation and scoring through a user-supplied client, and token-budget batching."""
from __future__ import annotations

import inspect
import queue
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.operators.parsing import parse_strict
from narralytics.session import stored

# A client maps a prompt to (text, finish reason); making one per task is the caller's factory.
Client = Callable[..., tuple[str, str]]
OUT_ROWS = 1024  # answered rows per output batch


class RejectedRequest(Exception):
    """Raised by a client for a request that no retry can mend."""


@dataclass
class Answer:
    text: str = ""
    reason: str = ""
    error: str = ""
    attempts: int = 0


class _Job:
    """One row on its way; ``started`` is set when a slot takes it."""

    def __init__(self, key, prompt) -> None:
        self.key, self.prompt = key, prompt
        self.started: float | None = None
        self.answer: Answer | None = None
        self.done = threading.Event()


class RequestWindow:
    """A bounded window of open requests in one task; answers come back in the order of the rows.

    ``size`` threads hold one request each. Rows are taken up to ``AHEAD`` windows before the oldest unanswered one, so a slow request delays
    the output but not the requests behind it, and memory stays bounded. A failed call is tried again after an exponential pause with
    jitter, until ``retries`` calls were made or the deadline (seconds from the first call of the row) would pass. A call that
    outlives the deadline is given up: its row gets an error, a new thread takes the slot. A client with a
    ``timeout`` parameter is told how many seconds are left and can end by itself.
    """

    AHEAD = 4
    LONGEST_PAUSE = 30.0

    def __init__(self, client: Client, size: int = 8, retries: int = 1, deadline: float | None = None, backoff: float = 0.2) -> None:
        self.client, self.size, self.retries, self.deadline, self.backoff = client, max(1, size), max(1, retries), deadline, backoff
        self.timed = "timeout" in inspect.signature(client).parameters
        self.waiting: queue.SimpleQueue[_Job | None] = queue.SimpleQueue()
        for _ in range(self.size):
            self._open_slot()

    def _open_slot(self) -> None:
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self) -> None:
        while (job := self.waiting.get()) is not None:
            job.started = time.monotonic()
            answer = self._ask(job)
            given_up = job.done.is_set()
            if given_up:            # another thread has this slot
                return
            job.answer = answer
            job.done.set()

    def _left(self, job: _Job) -> float | None:
        return None if self.deadline is None else self.deadline - (time.monotonic() - job.started)

    def _ask(self, job: _Job) -> Answer:
        error = ""
        for attempt in range(1, self.retries + 1):
            try:
                text, reason = self.client(job.prompt, timeout=self._left(job)) if self.timed else self.client(job.prompt)
                return Answer(text or "", reason or "", "", attempt)
            except RejectedRequest as exc:
                return Answer(error=f"{type(exc).__name__}: {exc}", attempts=attempt)
            except Exception as exc:  # noqa: BLE001
                error = f"{type(exc).__name__}: {exc}"
            pause = self.pause(job.key, attempt)
            left = self._left(job)
            if attempt == self.retries or (left is not None and pause >= left):
                break
            time.sleep(pause)
        return Answer(error=error, attempts=attempt)

    def pause(self, key, attempt: int) -> float:
        """Seconds before the next call: doubling, capped, and spread by a draw that depends on row and attempt."""
        longest = min(self.LONGEST_PAUSE, self.backoff * 2 ** (attempt - 1))
        return longest * random.Random(f"{key}:{attempt}").uniform(0.5, 1.0)

    def _wait(self, job: _Job) -> Answer:
        while not job.done.wait(None if self.deadline is None else 0.05 if job.started is None else max(0.001, self._left(job))):
            if job.started is not None and self._left(job) <= 0:
                job.done.set()
                if job.answer is None:
                    self._open_slot()
                    return Answer(error=f"TimeoutError: no answer within {self.deadline:g} s", attempts=self.retries)
        return job.answer or Answer(error="TimeoutError: given up", attempts=self.retries)

    def answers(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, answer) per (key, prompt), in order."""
        ahead: deque[_Job] = deque()
        try:
            for key, prompt in rows:
                if len(ahead) >= self.size * self.AHEAD:
                    job = ahead.popleft()
                    yield job.key, self._wait(job)
                ahead.append(_Job(key, prompt))
                self.waiting.put(ahead[-1])
            while ahead:
                job = ahead.popleft()
                yield job.key, self._wait(job)
        finally:
            for _ in range(self.size):
                self.waiting.put(None)


def request_rows(df: DataFrame, prompt: str, make_client: Callable[[], Client], retries: int = 1, key: str = "sample_id",
                 concurrency: int | None = None, window: int = 8, deadline: float | None = None, backoff: float = 0.2) -> DataFrame:
    """(key, raw_generation, finish_reason, request_error, attempts) per row; an error never fails the job.

    Every task makes one client and keeps up to ``window`` of its requests open, so ``concurrency`` partitions have at most
    ``concurrency * window`` open requests. The client is called from several threads unless ``window`` is 1.
    """
    rows = df if concurrency is None else df.repartition(concurrency, key)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type: list[pa.DataType] = []

        def pairs() -> Iterator[tuple]:
            for batch in batches:
                key_type[:] = [batch.schema.field(0).type]
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        answered = RequestWindow(make_client(), window, retries, deadline, backoff).answers(pairs())
        while some := list(islice(answered, OUT_ROWS)):
            found = [a for _, a in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in some], key_type[0]), pa.array([a.text for a in found], pa.string()), pa.array([a.reason for a in found], pa.string()),
                 pa.array([a.error for a in found], pa.string()), pa.array([a.attempts for a in found], pa.int32())],
                [key, "raw_generation", "finish_reason", "request_error", "attempts"])

    return rows.select(key, prompt).mapInArrow(
        run, f"`{key}` {kind}, raw_generation string, finish_reason string, request_error string, attempts int")


def generate_predictions(df: DataFrame, prompt: str, make_client: Callable[[], Client], model: str, run_name: str,
                         concurrency: int | None = None, **options) -> DataFrame:
    """Prediction table with parse and request outcome per row; failed rows stay, with empty fields.

    ``options`` go to ``request_rows``: retries, window, deadline, backoff.
    """
    answers = stored(request_rows(df, prompt, make_client, concurrency=concurrency, **options), "answers")  # asked once, read many times
    parsed = parse_strict(answers)
    failed = F.col("request_error") != ""
    return parsed.select(
        "sample_id", "predicted_narrative", "predicted_emotion_label", "raw_generation", "parse_success",
        F.when(failed, F.lit("")).otherwise(F.col("parse_error")).alias("parse_error"), "request_error", "finish_reason",
        F.lit(model).alias("model_name"), F.lit(run_name).alias("run_name"))


def score_rows(df: DataFrame, prompt: str, make_client: Callable[[], Client], schema: str, retries: int = 3,
               key: str = "sample_id", check: bool = True, **options) -> DataFrame:
    """JSON scores per row with retries; a row that keeps failing is an error unless ``check`` is off.

    ``options`` go to ``request_rows``: concurrency, window, deadline, backoff.
    """
    answered = stored(request_rows(df, prompt, make_client, retries, key, **options), "scores")
    if check:
        guard = F.when(F.col("request_error") != "", F.raise_error(F.concat(F.lit("request failed: "), F.col("request_error")))).otherwise(F.col("raw_generation"))
        answered = answered.withColumn("raw_generation", guard)
    return answered.select(key, F.from_json("raw_generation", schema).alias("s")).select(key, "s.*")


def token_batches(df: DataFrame, shard: str, ordinal: str, tokens: str, batch_size: int, max_batch_tokens: int) -> DataFrame:
    """Greedy batches of consecutive rows whose padded size (longest x count) stays in the budget.

    Every value of the ``shard`` column is packed on its own, in ordinal order; the caller's shards bound
    what one task sees, and a batch never crosses them.
    """
    kinds = dict(df.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal)
        ids, batch, count, longest = [], 0, 0, 0
        for size in pdf[tokens]:
            widest = max(longest, size)
            full = count >= batch_size or (max_batch_tokens > 0 and widest * (count + 1) > max_batch_tokens)
            if count and full:
                batch, count, widest = batch + 1, 0, size
            count, longest = count + 1, widest
            ids.append(batch)
        return pd.DataFrame({ordinal: pdf[ordinal], shard: pdf[shard], "batch": ids})

    return df.select(shard, ordinal, tokens).groupBy(shard).applyInPandas(pack, f"{ordinal} {kinds[ordinal]}, {shard} {kinds[shard]}, batch long")
