"""Run registered queries next to their DuckDB oracle and compare the row multisets."""
from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir: str) -> str:
    """Empty string when equal, else a short description of the difference."""
    start = time.time()
    df = entry.run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES[entry.name] = time.time() - start
    if not entry.sql:
        return "" if ours[1] else "no rows"
    result = con.execute(entry.sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        left, right = ours[1] - theirs[1], theirs[1] - ours[1]
        return (f"{sum(ours[1].values())} vs {sum(theirs[1].values())} rows, {sum(left.values())} differ; "
                f"ours {str(next(iter(left), None))[:300]} | oracle {str(next(iter(right), None))[:300]}")
    return "" if ours[1] else "both empty"


def main() -> None:
    from narralytics.catalog import load_all
    from narralytics.session import build_session

    sf_dir, names = sys.argv[1], [a for a in sys.argv[2:] if a != "--plain"]
    if "--plain" in sys.argv:  # Spark's own defaults instead of this repository's session
        from pyspark.sql import SparkSession
        catalog, spark = load_all(), SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("local[8]")
    con = connect(sf_dir)
    bad = 0
    for name, entry in load_all().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, entry, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {TIMES.get(name, 0):.1f}s of {time.time() - start:.1f}s {'' if entry.sql else '(rows only)'} {problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
