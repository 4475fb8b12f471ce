"""CSV files with quoted newlines, read in as many tasks as any text file.

In CSV with doubled quotes a position lies inside a quoted field when the number of quotes before it in the file is odd. A first narrow pass
counts the quotes of every file block; the parities of the blocks before give the state at which each block begins. A second narrow pass joins the lines of a block
into records, starting from that state. Only what a block edge cuts, at most one end and one beginning of a record a block, is
sorted and joined across blocks. The fields of a record are split by Spark's own ``from_csv``.

Quotes stand only around fields and, doubled, inside them, as the sink writes them. A last record without closing quote ends with the file.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"
WHOLE, TAIL, HEAD = 0, 1, 2      # a tail stands before the head of its block
OUT_ROWS = 4096
_PARTS = "file string, start long, kind int, text string"


class BlockRecords:
    """Lines of consecutive blocks in, records and the pieces that block edges cut out."""

    def __init__(self, inside: set[tuple[str, int]], first: dict[str, int]) -> None:
        self.inside, self.first = inside, first
        self.block: tuple[str, int] | None = None
        self.lines: list[str] = []
        self.open = self.cut = self.header = False

    def _emit(self, kind: int) -> Iterator[tuple]:
        text, self.lines = "\n".join(self.lines), []
        if kind == WHOLE:
            text = text.removesuffix("\r")
            if not text:
                return
        if self.header and kind != TAIL:     # the first record of a file; its tail, in later blocks, falls away with it
            self.header = False
            if kind == WHOLE:
                return
            text = None
        yield (*self.block, kind, text)

    def end(self) -> Iterator[tuple]:
        """Closes the block: an unfinished record is handed on."""
        if self.block is not None and self.lines:
            yield from self._emit(TAIL if self.cut else HEAD)

    def add(self, file: str, start: int, line: str) -> Iterator[tuple]:
        if (file, start) != self.block:
            yield from self.end()
            self.block = file, start
            self.open = self.cut = (file, start) in self.inside
            self.header = self.first.get(file) == start
        if self.header and not self.open and not self.lines:
            line = line.removeprefix(BOM)
        self.lines.append(line)
        self.open ^= line.count('"') % 2 == 1
        if not self.open:
            yield from self._emit(TAIL if self.cut else WHOLE)
            self.cut = False


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def block_states(lines: DataFrame) -> tuple[set[tuple[str, int]], dict[str, int]]:
    """(blocks that begin inside quotes, first block with text per file): at most an entry per file split, of which Spark's driver holds a list as well."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    filled = F.max(~value.isin("", "\r", BOM, BOM + "\r"))
    blocks = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"), filled.alias("filled"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)   # one row per block
    states = blocks.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
                           (F.col("filled") & (F.coalesce(F.sum(F.col("filled").cast("int")).over(before), F.lit(0)) == 0)).alias("first"))
    found = states.where("inside OR first").collect()
    return {(r["file"], r["start"]) for r in found if r["inside"]}, {r["file"]: r["start"] for r in found if r["first"]}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text): every record of the files but their headers and blank lines."""
    lines = text_lines(spark, path)
    inside, first = block_states(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = BlockRecords(inside, first), []

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string()))],
                                                 ["file", "start", "kind", "text"])
                out.clear()

        for batch in batches:
            for line, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                out.extend(work.add(file, start, line))
            yield from flushed(OUT_ROWS)
        out.extend(work.end())
        yield from flushed(1)

    parts = lines.mapInArrow(run, _PARTS)
    # rows of the cut records only; the running maximum names the block a record began in
    begun = F.max(F.when(F.col("kind") == HEAD, F.col("start"))).over(Window.partitionBy("file").orderBy("start", "kind"))
    pieces = parts.where(F.col("kind") != WHOLE).withColumn("begun", begun)
    joined = pieces.groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("p"))
    headless = ~F.exists("p", lambda x: x["text"].isNull())
    whole = joined.where(headless).select(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), r"\r\z", "").alias("text"))
    return parts.where(F.col("kind") == WHOLE).select("text").unionByName(whole)
