"""Small tables with the cases every operator has to stand: nulls, empties, repeats, ties, long texts."""
import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, kind string"
WORDS = "the of and to river stone lamp garden winter music paper window silver morning harbour letter engine forest".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, texts, first=0):
    """Documents with ids from ``first``; extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    """Nulls in every column, empty and blank texts, equal rows, one long text."""
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", "src0", 0, "a", "b", "c"), (3, " \t\n ", "de", "src1", 4, "a", "b", "c"),
            (None, "no id here", "en", "src0", 10, "a", "b", "c"), (4, "One Two", "fr", "src2", 7, "a", "b", "c"),
            (4, "One Two", "fr", "src2", 7, "a", "b", "c"), (5, prose(1, 40_000), "es", "other", 0, "a", "b", "c"),
            (6, "été ÀÉ 😀 é ▁x <s> <|endoftext|> it's 12345 %%%", "xx", "src3", 5, "a", "b", "c")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def count(df):
    return df.agg(F.count(F.lit(1))).first()[0]
