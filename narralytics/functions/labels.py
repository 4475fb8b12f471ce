"""Label vocabularies as Columns."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.constants import COARSE_LABEL


def vocabulary(spark: SparkSession, labels: list[str], name: str = "label") -> DataFrame:
    """Vocabulary as a table with its position; the size is fixed by the caller's list."""
    return spark.createDataFrame(list(enumerate(labels)), f"position int, {name} string")


def label_mapping() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(COARSE_LABEL.items())])


def remap_label(label: Column) -> Column:
    """Coarse label of a fine label; null for a blank one. Any other label stops the job and is named."""
    key = F.lower(F.trim(label))
    unknown = F.raise_error(F.concat(F.lit("label outside the taxonomy: "), label))
    return F.when(F.coalesce(key, F.lit("")) != "", F.coalesce(F.try_element_at(label_mapping(), key), unknown))


def label_code(label: Column, labels: list[str]) -> Column:
    """Zero-based code; anything outside the vocabulary gets the code after the last label."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.coalesce(F.trim(label), F.lit("")))
    return F.when(position == 0, F.lit(len(labels))).otherwise(position - 1).cast("int")
