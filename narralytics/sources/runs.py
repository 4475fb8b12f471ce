"""Run trees: summaries whose keys are part of the path."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_PATTERN = r"([^/]+)/seed_(\d+)/([^/]+)/evaluation/run_([^/]+)/"
RUN_LAYOUT = "{condition}/seed_{seed}/{dataset}/evaluation/run_{run_ts}/metrics/summary.json"
RUN_KEYS = ["condition", "seed", "dataset", "run_ts"]


def read_run_tree(spark: SparkSession, path: str, schema: str, pattern: str = RUN_PATTERN,
                  keys: Sequence[str] = tuple(RUN_KEYS)) -> DataFrame:
    """Every run summary under a root, with its keys taken from the file path."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").schema(schema).json(path)
    return rows.select(*[F.regexp_extract("_metadata.file_path", pattern, i).alias(k) for i, k in enumerate(keys, 1)],
                       *rows.columns, F.col("_metadata.file_path").alias("run_path"))


def _glob_text(value: str) -> str:
    """A folder name as it stands, for a glob pattern."""
    return re.sub(r"([\\*?\[\]{}^,])", r"\\\1", value)


def run_files(spark: SparkSession, root: str, layout: str, where: Mapping[str, Sequence[str]]) -> list[str]:
    """Files of the tree whose keys have the asked values.

    The values become part of the pattern that the file system lists by, folder by folder, so other branches of the tree are never listed.
    """
    def part(key: re.Match) -> str:
        return "{" + ",".join(_glob_text(str(v)) for v in where[key[1]]) + "}" if key[1] in where else "*"

    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{_glob_text(root.rstrip('/'))}/{re.sub(r'{([^}]+)}', part, layout)}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(str(f.getPath()) for f in found or [])


def read_runs(spark: SparkSession, root: str, schema: str, layout: str = RUN_LAYOUT, **where: Sequence[str]) -> DataFrame:
    """Run summaries of a tree described by ``layout``, with their keys; ``where`` gives the values wanted per key.

    ``layout`` names the keys in braces. Only files that fit are listed and opened.
    """
    names = re.findall(r"{([^}]+)}", layout)
    if unknown := set(where) - set(names):
        raise ValueError(f"the layout has no {sorted(unknown)}")
    pattern = "/" + "".join("([^/]+)" if i % 2 else re.escape(x).replace(r"\*", "[^/]*") for i, x in enumerate(re.split(r"{([^}]+)}", layout))) + "$"
    files = run_files(spark, root, layout, where) if all(len(v) for v in where.values()) else []
    reader = spark.read.option("multiLine", "true").schema(schema)
    rows = reader.json([_glob_text(f) if re.search(r"[*?\[\]{}]", f) else f for f in files]) if files else None
    if rows is None:
        fields = ", ".join([*(f"{n} string" for n in names), schema, "run_path string"])
        return spark.createDataFrame([], fields)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))      # Spark gives paths as URIs
    return rows.select(*[F.regexp_extract(path, pattern, i).alias(n) for i, n in enumerate(names, 1)],
                       *rows.columns, F.col("_metadata.file_path").alias("run_path"))


def latest_runs(runs: DataFrame, by: Sequence[str] = ("condition", "seed", "dataset"), ts: str = "run_ts") -> DataFrame:
    """Newest run per key; run stamps sort like time."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(*by, "r.*")


def latest_complete_runs(runs: DataFrame, gold_rows: DataFrame, by: Sequence[str] = ("condition", "seed", "dataset"),
                         ts: str = "run_ts") -> DataFrame:
    """Newest run per key that aligned every gold row of its dataset and missed none."""
    expected = gold_rows.select("dataset", "gold_rows")
    complete = runs.join(expected, "dataset").where(
        (F.col("num_aligned_rows") == F.col("gold_rows")) & (F.coalesce("num_missing_prediction_rows", F.lit(0)) == 0))
    return latest_runs(complete.drop("gold_rows"), by, ts)


def runs_on_dataset(runs: DataFrame, file_name: str, column: str = "gold_path") -> DataFrame:
    """Runs whose gold file has the given name, whatever its folder."""
    return runs.where(F.element_at(F.split(column, "/"), -1) == file_name)
