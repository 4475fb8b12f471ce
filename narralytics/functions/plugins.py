"""Pluggable encoder, tagger, tokeniser and stemmer: one-method protocols with offline defaults.

The defaults are deterministic stand-ins for learned models. Scores made with them compare runs
with each other; they are not comparable with scores of a pretrained model.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from narralytics.constants import FIRST_PERSON_WORDS, PAST_IRREGULAR, PRESENT_VERBS
from narralytics.functions import kernels, porter
from narralytics.functions.text import tokens_linguistic


class Encoder(Protocol):
    """Turns a batch of texts into one vector each."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=8)
def known_slots(dim: int, seed: int) -> kernels.KnownSlots:
    """One table per process, so the tasks that a worker runs one after another share what they know."""
    return kernels.KnownSlots(dim, seed)


def lowered(texts: list[str]) -> list[str]:
    """Every text in lower case. They are lowered as the lines of one text, if none has a line end."""
    lines = "\n".join(texts).lower().split("\n")
    return lines if len(lines) == len(texts) else [t.lower() for t in texts]


class HashingEncoder:
    """Seeded feature hashing over lower-cased words."""

    def __init__(self, dim: int = 32, seed: int = 7):
        self.dim, self.seed, self.slots = dim, seed, known_slots(dim, seed)

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.slots.vectors(t.lower().split() for t in texts)

    def encode_runs(self, words: list[str], at: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """Vectors of ``size`` texts that are runs of words: ``words[at]`` one after another, ``of`` the text each belongs to."""
        slots = np.array([self.slots[w] for w in lowered(words)], dtype=np.int64)
        return self.slots.summed(slots[at], of, size)


class CharHashingEncoder:
    """Seeded feature hashing over character trigrams, for single tokens."""

    def __init__(self, dim: int = 32, seed: int = 11):
        self.dim, self.seed, self.slots = dim, seed, known_slots(dim, seed)

    def encode(self, texts: list[str]) -> np.ndarray:
        texts = lowered(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(sizes) or not sizes.all():       # an empty text is one feature of two characters
            padded = [f"^{t}$" for t in texts]
            return self.slots.vectors([p[i:i + 3] for i in range(max(1, len(p) - 2))] for p in padded)
        joined = f"^{'$^'.join(texts)}$"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(sizes)), sizes)
        bits = int(points.max()).bit_length()
        codes = (points[start] << 2 * bits) | (points[start + 1] << bits) | points[start + 2]
        if bits > 7:
            codes = np.unique(codes, return_inverse=True)[1]
        place = np.empty(int(codes.max()) + 1, dtype=np.int64)
        place[codes] = start                                 # one place where each feature stands
        seen = np.zeros(len(place), dtype=bool)
        seen[codes] = True
        place[seen] = [self.slots[joined[i:i + 3]] for i in place[seen].tolist()]
        return self.slots.summed(place[codes], np.repeat(np.arange(len(sizes)), sizes), len(sizes))


class CachedEncoder:
    """Remembers the vectors of a bounded number of texts, so one that repeats in a task is encoded once."""

    def __init__(self, encoder: Encoder, limit: int = 200_000):
        self.encoder, self.limit, self.known, self.table = encoder, limit, {}, np.empty((0, 0))

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return self.encoder.encode(texts)
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, list(dict.fromkeys(texts))
        if new:
            vectors, first = np.asarray(self.encoder.encode(new)), len(self.known)
            if first + len(new) > len(self.table) or not first:     # the table doubles, like a list
                larger = np.empty((max(1024, 2 * first, first + len(new)), vectors.shape[1]), dtype=vectors.dtype)
                if first:
                    larger[:first] = self.table[:first]
                self.table = larger
            self.table[first:first + len(new)] = vectors
            self.known.update(zip(new, range(first, first + len(new))))
        return self.table[[self.known[t] for t in texts]]


def encode_column(make_encoder: Callable[[], Encoder]) -> Callable[[Column], Column]:
    """Arrow UDF around an encoder, made once per Python worker task."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.Series(list(encoder.encode(batch.fillna("").tolist())), dtype=object)

    return run


def strings(values: pa.Array) -> list[str]:
    """An array of strings as a list; many times faster than ``to_pylist``, which goes by scalars."""
    return values.to_numpy(zero_copy_only=False).tolist()


def stemmed(lists: pa.ListArray, stem: Callable[[str], str], rows: int = 512) -> pa.ListArray:
    """The lists with every token stemmed. Only the distinct tokens of a few rows are Python strings at a time."""
    values = []
    for start in range(0, len(lists), rows):
        coded = lists.slice(start, rows).flatten().dictionary_encode()
        values.append(pa.array([stem(t) for t in strings(coded.dictionary)], pa.string()).take(coded.indices))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.concat_arrays([pa.array([], pa.string()), *values]), mask=lists.is_null())


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Porter stems; a bounded cache means a frequent word is stemmed once per task."""
    cached = lru_cache(maxsize=200_000)(porter.stem)
    for batch in batches:
        yield stemmed(batch, cached)


class RuleTagger:
    """Verb counts from a small lexicon plus suffix rules, as plain column expressions."""

    past_pattern = r"^(?:" + "|".join(PAST_IRREGULAR) + r"|\p{L}{2,}ed)$"
    other_pattern = r"^(?:" + "|".join(PRESENT_VERBS) + r"|\p{L}{3,}ing)$"

    def __init__(self, first_person_words: list[str] = FIRST_PERSON_WORDS):
        self.first_person_words = first_person_words

    def add_counts(self, df: DataFrame, text: str) -> DataFrame:
        """Adds ``verbs``, ``past_verbs``, ``first_person`` and ``tokens``."""
        # a generated row is computed once; a plain column would be computed again by every filter on the counts
        counts = F.transform(F.array(tokens_linguistic(F.col(text))), lambda words: F.struct(
            F.size(F.filter(words, lambda t: t.rlike(self.past_pattern))).alias("past"),
            F.size(F.filter(words, lambda t: t.rlike(self.other_pattern))).alias("other"),
            F.size(F.filter(words, lambda t: t.isin(self.first_person_words))).alias("own"),
            F.size(words).alias("all")))
        return (
            df.withColumn("_counts", F.explode_outer(counts))
            .withColumn("past_verbs", F.col("_counts.past"))
            .withColumn("verbs", F.col("_counts.past") + F.col("_counts.other"))
            .withColumn("first_person", F.col("_counts.own"))
            .withColumn("tokens", F.col("_counts.all"))
            .drop("_counts")
        )


class StatisticalTagger:
    """Adapter for a learned tagger: ``make`` returns a callable from texts to (word, tag) lists."""

    def __init__(self, make: Callable[[], Callable[[list[str]], Iterable[list[tuple[str, str]]]]],
                 verb_tags: set[str], past_tags: set[str]):
        self.make, self.verb_tags, self.past_tags = make, verb_tags, past_tags

    def add_counts(self, df: DataFrame, text: str) -> DataFrame:
        make, verbs, past = self.make, self.verb_tags, self.past_tags
        own_words = set(FIRST_PERSON_WORDS)

        @F.pandas_udf("verbs int, past_verbs int, first_person int, tokens int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tagger = make()
            for batch in batches:
                rows = [(sum(tag in verbs for _, tag in doc), sum(tag in past for _, tag in doc),
                         sum(word.lower() in own_words for word, _ in doc), len(doc))
                        for doc in tagger(batch.fillna("").tolist())]
                yield pd.DataFrame(rows, columns=["verbs", "past_verbs", "first_person", "tokens"])

        return df.withColumn("_c", count(F.col(text))).select(*df.columns, "_c.*")
