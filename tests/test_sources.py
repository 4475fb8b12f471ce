import collections
import json

import pytest

from narralytics import session
from narralytics.catalog import load_all
from narralytics.functions.plugins import RuleTagger
from narralytics.operators import corpus as C
from narralytics.operators.align import ValidationError
from narralytics.session import Scratch, clean_scratch, scratch_path, shared_dir
from narralytics.sources import runs as SR
from narralytics.sources import split_csv as SC
from narralytics.sources import tables as S
from narralytics.streaming.filters import filter_stream


def test_csv_bom_quotes_newlines_and_na(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text('﻿line,source_text,emotion_label,reference_narrative\n7,"a\nb ""q""",Joy,NA\n3,,Fear,x\n', encoding="utf-8")
    rows = {r["sample_id"]: r for r in S.read_gold(spark, str(path), "line").collect()}
    assert rows[1]["source_text"] == 'a b "q"' and rows[1]["reference_narrative"] == "NA"
    assert rows[0]["source_text"] == "" and rows[0]["emotion_label"] == "Fear"


RECORDS = ['1,"x\ny ""q""",NA', '2,,""', "", '3,"tab\t, comma\n\n\n"," lead"', "4,plain,  sp ", '5,"cr\r\nin\r",z', "  ", "6,short", '7,a,b,c,d',
           '8,"ends\n\nblank","q\n"', '9,"",x', '"10","""","é😀\n""\n"""']


def split_read(spark, path, size, schema="a string, b string, c string"):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = SC.text_lines(spark, path).rdd.getNumPartitions()
        return parts, sorted((tuple(r) for r in S.read_csv(spark, path, schema).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_blocks_cut_at_every_line(end):
    """Records from blocks cut before any line, or before every line, equal those of one block."""
    text = end.join(["\ufeffa,b,c", *RECORDS]) + end
    lines = text.split("\n")[:-1]
    want = [r.removesuffix("\r") for r in RECORDS if r]

    def records(starts):
        odd, inside, filled = 0, set(), None
        blocks = list(zip(starts, [*starts[1:], len(lines)]))
        for a, b in blocks:
            inside |= {("f", a)} if odd else set()
            odd ^= sum(x.count('"') for x in lines[a:b]) % 2
            filled = a if filled is None and any(x.strip("\r\ufeff") for x in lines[a:b]) else filled
        work, out = SC.BlockRecords(inside, {"f": filled}), []
        for a, b in blocks:
            for line in lines[a:b]:
                out.extend(work.add("f", a, line))
        out.extend(work.end())
        whole, cut = [p[3] for p in out if p[2] == SC.WHOLE], {}
        at = None
        for _, start, kind, piece in sorted((p for p in out if p[2] != SC.WHOLE), key=lambda p: p[1:3]):
            at = start if kind == SC.HEAD else at
            cut.setdefault(at, []).append(piece)
        return sorted(whole + ["\n".join(p).removesuffix("\r") for p in cut.values() if None not in p])

    for cut in range(1, len(lines)):
        assert records([0, cut]) == sorted(want), cut
    for step in range(1, len(lines)):
        assert records(list(range(0, len(lines), step))) == sorted(want), step


@pytest.mark.parametrize("size", [3, 11, 40, 10_000])
def test_csv_file_is_read_in_many_tasks(spark, tmp_path, size):
    path = tmp_path / "x.csv"
    path.write_text("\n\ufeffa,b,c\n".replace("\n\ufeff", "\ufeff") + "\n".join(RECORDS) + "\n", encoding="utf-8", newline="")
    want = sorted((tuple(r) for r in spark.read.options(**S.CSV_OPTIONS).csv(str(path)).collect()), key=repr)
    parts, got = split_read(spark, str(path), size)
    assert got == want and (size == 10_000 or parts > 1)


def test_csv_header_with_newline_and_empty_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for i in range(3):
        (tmp_path / "x" / f"{i}.csv").write_text('\n"a\nb",c\n' + f'{i},"u\nv"\n' * i, newline="")
    _, got = split_read(spark, str(tmp_path / "x"), 4, "`a\nb` int, c string")
    assert got == [(1, "u\nv"), (2, "u\nv"), (2, "u\nv")]
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\nx\n', newline="")
    assert split_read(spark, str(tmp_path / "open.csv"), 5, "a int, b string")[1][0][0] == 1


def test_one_written_file_comes_back_whole(spark, tmp_path):
    texts = [(i, " " * (i % 5) + f'line "{i}"\n' * (i % 7) + ',"' * (i % 3), f"x{i}") for i in range(400)]
    path = S.write_csv(spark.createDataFrame(texts, "a int, b string, c string").coalesce(1), str(tmp_path / "out"))
    parts, got = split_read(spark, path, 2000, "a int, b string, c string")
    assert parts > 5 and got == sorted(((a, b or None, c) for a, b, c in texts), key=repr)


def test_csv_missing_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValidationError):
        S.read_csv(spark, str(tmp_path / "x.csv"), "a int, c int")


def test_predictions_ids(spark, tmp_path):
    head = "sample_id,predicted_narrative,predicted_emotion_label\n"
    (tmp_path / "ok.csv").write_text(head + "1.0,x,Joy\n2,y,Fear\n")
    assert sorted(r["sample_id"] for r in S.read_predictions(spark, str(tmp_path / "ok.csv")).collect()) == [1, 2]
    (tmp_path / "dup.csv").write_text(head + "1,x,Joy\n1.0,y,Fear\n")
    with pytest.raises(ValidationError):
        S.read_predictions(spark, str(tmp_path / "dup.csv"))
    (tmp_path / "bad.csv").write_text(head + "one,x,Joy\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.read_predictions(spark, str(tmp_path / "bad.csv"))


def test_jsonl_contract(spark, tmp_path):
    good, bad, empty = tmp_path / "g.jsonl", tmp_path / "b.jsonl", tmp_path / "e.jsonl"
    row = {"system": "s", "instruction": "i", "input": "x", "output": "o"}
    good.write_text(json.dumps(row) + "\n")
    bad.write_text(json.dumps(row) + "\n" + json.dumps({"system": "s"}) + "\n")
    empty.write_text("")
    assert S.read_jsonl(spark, str(good), S.ALPACA_SCHEMA).count() == 1
    for path in (bad, empty):
        with pytest.raises(ValidationError):
            S.read_jsonl(spark, str(path), S.ALPACA_SCHEMA)


def test_run_tree_layout(spark, tmp_path):
    for seed, stamp, rows, missing in ((1, "20260101_010101", 5, 0), (1, "20260202_010101", 4, 1), (2, "20260101_010101", 5, 0)):
        folder = tmp_path / "joint" / f"seed_{seed}" / "stage1" / "evaluation" / f"run_{stamp}" / "metrics"
        folder.mkdir(parents=True)
        (folder / "summary.json").write_text(json.dumps({"num_aligned_rows": rows, "num_missing_prediction_rows": missing, "gold_path": "/x/test.csv"}, indent=2))
    tree = SR.read_run_tree(spark, str(tmp_path), "num_aligned_rows long, num_missing_prediction_rows long, gold_path string")
    assert {(r["condition"], r["seed"], r["run_ts"]) for r in SR.latest_runs(tree).collect()} == {
        ("joint", "1", "20260202_010101"), ("joint", "2", "20260101_010101")}
    gold = spark.createDataFrame([("stage1", 5)], "dataset string, gold_rows long")
    assert {(r["seed"], r["run_ts"]) for r in SR.latest_complete_runs(tree, gold).collect()} == {("1", "20260101_010101"), ("2", "20260101_010101")}
    assert SR.runs_on_dataset(tree, "test.csv").count() == 3 and SR.runs_on_dataset(tree, "other.csv").count() == 0


def test_run_tree_lists_only_what_is_asked(spark, tmp_path):
    for condition in ("joint", "single", "a,{b}*"):
        for seed in range(4):
            folder = tmp_path / condition / f"seed_{seed}" / "stage1" / "evaluation" / f"run_2026010{seed}_0" / "metrics"
            folder.mkdir(parents=True)
            (folder / "summary.json").write_text(json.dumps({"n": seed}, indent=2))
            (folder / "other.json").write_text("not json")
    every = SR.read_runs(spark, str(tmp_path), "n long")
    assert sorted((r.condition, r.seed, r.dataset, r.run_ts, r.n) for r in every.collect()) == sorted(
        (c, str(s), "stage1", f"2026010{s}_0", s) for c in ("joint", "single", "a,{b}*") for s in range(4))
    some = SR.read_runs(spark, str(tmp_path), "n long", condition=["joint", "a,{b}*"], seed=["2", "9"])
    assert len(some.inputFiles()) == 2 and sorted((r.condition, r.n) for r in some.collect()) == [("a,{b}*", 2), ("joint", 2)]
    none = SR.read_runs(spark, str(tmp_path), "n long", condition=["nothing"])
    assert none.count() == 0 and none.columns == every.columns and SR.read_runs(spark, str(tmp_path), "n long", seed=[]).count() == 0
    with pytest.raises(ValueError, match="dates"):
        SR.read_runs(spark, str(tmp_path), "n long", dates=["x"])


def test_nested_array_document(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"topic_id": 1, "count": 2, "name": "n", "top_terms": ["a"], "representative_docs": []}], indent=2))
    assert S.read_nested(spark, str(tmp_path / "t.json"), S.TOPIC_SUMMARY_SCHEMA).first()["top_terms"] == ["a"]


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_is_cleaned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    scratch = Scratch(spark)
    scratch.write(spark.range(3), "a")
    kept = scratch.write(spark.range(4), "b")
    scratch.drop("a")
    folders = lambda: sorted(p.name[0] for p in (tmp_path / "shared" / "narralytics").glob("*"))
    assert folders() == ["b"] and kept.count() == 4
    with pytest.raises(ValueError):
        scratch.write(spark.range(1), "b")
    clean_scratch(spark)
    assert folders() == []
    clean_scratch(spark)


@pytest.mark.parametrize("cap", [None, 5])
def test_streamed_filter_equals_batch_and_restarts(spark, tmp_path, cap):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = ["I walked home and we talked.", "they go on.", "we wanted my car and asked."]
    rows = lambda start: spark.createDataFrame([(start + i, texts[i % 3]) for i in range(4)], "id long, text string")

    def drain():
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
        filter_stream(stream, out, str(tmp_path / "cp"), "id", max_rows=cap, tagger=RuleTagger()).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(f"{out}/kept").collect())

    rows(0).coalesce(1).write.mode("append").parquet(source)
    drain()
    rows(4).coalesce(1).write.mode("append").parquet(source)
    got = drain()
    read = spark.read.parquet(source).orderBy("id").limit(cap or 100)
    assert got == sorted(r["id"] for r in C.narrative_filter(read).collect())


def test_streamed_queries_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    queries = load_all()
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("narrative_filter_streamed", "telemetry_windows_streamed"):
        one, many = (collections.Counter(tuple(r) for r in queries[name].run(spark, at).collect()) for at in (sf_dir, str(tmp_path)))
        assert one and one == many, name
