"""Streamed stop decisions against the batch form."""
import numpy as np

from narralytics.operators.runs import early_stop
from narralytics.streaming import early_stop as E

SCHEMA = "run string, step long, eval_loss double"


def histories(seed, runs=12):
    rng = np.random.default_rng(seed)
    return [(f"r{r}", int(s), round(float(1 + rng.normal() / 8), 3)) for r in range(runs) for s in range(10, 10 * int(rng.integers(2, 9)), 10)]


def drained(spark, tmp_path, parts, name="a", **options):
    source, out = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        E.stop_stream(stream, out, str(tmp_path / f"cp-{name}"), **options).start().awaitTermination()     # a restart per part
    return spark.read.parquet(out)


COLUMNS = ["run", "best_step", "best_loss", "latest_step", "latest_loss", "validations_without_improvement", "relative_degradation", "reason"]


def test_drained_stream_equals_the_batch_form(spark, tmp_path):
    rows = histories(1)
    np.random.default_rng(2).shuffle(rows)                  # validations arrive in any order
    corrected = [(r, s, loss + 0.3) for r, s, loss in rows[:5]]
    parts = [[tuple(x) for x in rows[:20]], [tuple(x) for x in rows[20:]], corrected]
    parts = [[(str(r), int(s), float(v)) for r, s, v in p] for p in parts]
    last = {(r, s): v for p in parts for r, s, v in p}
    want = early_stop(spark.createDataFrame([(r, s, v) for (r, s), v in last.items()], SCHEMA)).select(*COLUMNS)
    got = E.latest_decisions(drained(spark, tmp_path, parts)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_decision_per_run(spark, tmp_path):
    rows = sorted(histories(3), key=lambda r: r[1])
    parts = [[r for r in rows if r[1] == s] for s in sorted({r[1] for r in rows})]
    got = {r.run: (r.latest_step, r.reason) for r in drained(spark, tmp_path, parts, once=True).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        seen = {}
        for _, step, loss in (r for r in rows if r[0] == run):
            seen[step] = loss
            row = E.decide(seen, 2, 0.10)
            if row[-1]:
                want[run] = (row[2], row[-1])
                break
    assert got == want and drained(spark, tmp_path, [], "a").count() == len(want)
