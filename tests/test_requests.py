"""Requests in flight: order, window, retries, deadline."""
import threading
import time

import pytest

from narralytics.operators import generation as G


class Server:
    """A stub that counts calls and how many are open at once."""

    def __init__(self, delay=0.05, failures=0, slow=()):
        self.delay, self.failures, self.slow = delay, failures, slow
        self.lock, self.open, self.most, self.calls = threading.Lock(), 0, 0, []

    def __call__(self, prompt):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
            self.calls.append(prompt)
            nth = self.calls.count(prompt)
        try:
            time.sleep(self.slow[prompt] if prompt in self.slow else self.delay)
            if nth <= self.failures:
                raise ConnectionError(f"try {nth}")
            if prompt == "bad":
                raise G.RejectedRequest("not a prompt")
            return f"<{prompt}>", "stop"
        finally:
            with self.lock:
                self.open -= 1


def timed(window, rows=64, **stub):
    server = Server(**stub)
    start = time.perf_counter()
    got = list(G.RequestWindow(server, window).answers((i, f"p{i}") for i in range(rows)))
    return time.perf_counter() - start, got, server


def test_window_of_eight_is_six_times_faster():
    slow, one, _ = timed(1)
    fast, eight, server = timed(8)
    assert [(k, a.text, a.reason, a.error) for k, a in eight] == [(i, f"<p{i}>", "stop", "") for i in range(64)] == [(k, a.text, a.reason, a.error) for k, a in one]
    assert sorted(server.calls) == sorted(f"p{i}" for i in range(64))      # one call per row
    assert server.most == 8 and slow / fast >= 6


def test_slow_request_does_not_hold_up_those_behind_it():
    seconds, got, server = timed(4, rows=17, delay=0.02, slow={"p0": 0.3})
    assert [k for k, _ in got] == list(range(17)) and server.calls.index("p10") < 17
    assert seconds < 0.3 + 0.15


def test_rows_are_taken_only_some_windows_ahead():
    taken = []
    rows = ((i, taken.append(i) or "p") for i in range(1000))
    answers = G.RequestWindow(Server(0.001), 2).answers(rows)
    next(answers)
    assert len(taken) <= 2 * G.RequestWindow.AHEAD + 1
    answers.close()


def test_retries_pause_longer_each_time_and_rejections_end_at_once():
    server = Server(0.0, failures=2)
    window = G.RequestWindow(server, 2, retries=3, backoff=0.05)
    start = time.perf_counter()
    (_, answer), = window.answers([(1, "a")])
    assert (answer.text, answer.error, answer.attempts) == ("<a>", "", 3) and time.perf_counter() - start >= 0.075
    pauses = [window.pause("k", n) for n in range(1, 12)]
    assert all(0.5 * min(30, 0.05 * 2 ** n) <= p <= min(30, 0.05 * 2 ** n) for n, p in enumerate(pauses)) and pauses == [window.pause("k", n) for n in range(1, 12)]
    assert window.pause("other", 1) != window.pause("k", 1)
    (_, answer), = G.RequestWindow(Server(0.0, failures=9), retries=2, backoff=0.0).answers([(1, "a")])
    assert answer == G.Answer("", "", "ConnectionError: try 2", 2)
    (_, answer), = G.RequestWindow(Server(0.0), retries=5).answers([(1, "bad")])
    assert answer == G.Answer("", "", "RejectedRequest: not a prompt", 1)


def test_deadline_gives_a_row_up_and_frees_its_slot():
    server = Server(0.01, slow={"p1": 30, "p2": 30})
    start = time.perf_counter()
    got = list(G.RequestWindow(server, 2, deadline=0.3).answers((i, f"p{i}") for i in range(30)))
    assert time.perf_counter() - start < 5
    errors = {k: a.error for k, a in got if a.error}
    assert list(errors) == [1, 2] and all(e == "TimeoutError: no answer within 0.3 s" for e in errors.values())
    assert [a.text for k, a in got if k not in errors] == [f"<p{i}>" for i in range(30) if i not in errors]
    (_, answer), = G.RequestWindow(Server(0.0, failures=99), retries=50, deadline=0.3, backoff=0.1).answers([(1, "a")])
    assert answer.error.startswith("ConnectionError") and 1 < answer.attempts < 6     # no call after the deadline


def test_client_is_told_the_time_left():
    def client(prompt, timeout):
        return f"{0 < timeout <= 2}", "stop"

    (_, answer), = G.RequestWindow(client, deadline=2).answers([(1, "a")])
    assert answer.text == "True"


def test_rows_of_a_table(spark):
    def make():
        def call(prompt):
            if prompt is None:
                raise ValueError("no prompt")
            return prompt.upper(), "stop"
        return call

    rows = spark.createDataFrame([(f"k{i}", None if i == 7 else f"p{i}") for i in range(3000)], "id string, text string").coalesce(1)
    got = G.request_rows(rows, "text", make, key="id", window=4).collect()
    assert [r["id"] for r in got] == [f"k{i}" for i in range(3000)]
    assert all((r.raw_generation, r.finish_reason, r.request_error) == (("", "", "ValueError: no prompt") if r["id"] == "k7" else ("P" + r["id"][1:], "stop", ""))
               for r in got)
    assert G.request_rows(rows.limit(0), "text", make, key="id", concurrency=3).count() == 0


@pytest.mark.parametrize("size", [1, 3])
def test_a_closed_window_ends_its_threads(size):
    before = threading.active_count()
    list(G.RequestWindow(Server(0.0), size).answers([(i, "p") for i in range(10)]))
    time.sleep(0.2)
    assert threading.active_count() <= before
