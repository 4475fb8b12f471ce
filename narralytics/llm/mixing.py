"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell; the cells are raked in turn to the three target
marginals until they agree. A cell's documents are then kept with one probability, at most 1. The expected tokens
are ``budget`` of all tokens, and the cells are raked once more under this bound: a value that has fewer tokens
than its target asks for is kept whole and the others of its kind share the rest, and every margin that can be met with
the budget is met. A smaller budget meets more margins.

Topics come from the texts: hashed word counts, less the mean of the document's language, go to the nearest of ``TOPICS``
centroids. Means and centroids are those of all rows: the vectors are written once, and every pass over them adds up whole numbers per task,
so the fit does not depend on file layout. Centres start from candidates that are drawn over all rows by distance (scalable k-means++).

Without given targets every source of the table has the same share, and languages and topics have shares in proportion to the square
root of their tokens, so that rare ones are raised. A value that no target names keeps its share.

Only cells reach the driver, one row per source, language and topic that occur together; a sweep is one pass and one sort over them. More than
``MAX_CELLS`` cells are an error.

Defined results: null source or language: ``(other)``; a text without words has the topic ``empty`` and counts one token; targets of absent
values are spread over the present ones; rows that are equal in doc_id and text share their draw; an empty table gives an empty result;
clashing column names are kept.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import slices, text_or_empty, unit_draw, utf8, written
from narralytics.session import small_side

OTHER, EMPTY = "(other)", "empty"
SEED = 20
BUDGET = 0.5
SWEEPS = 500
TOLERANCE = 1e-10
MAX_CELLS = 10_000_000
TOPICS = 8
WIDTH = 256         # places that words are hashed to
ROUNDS = 20         # passes that move the centroids
DRAWS, DRAWN = 4, 16    # passes that draw starting candidates, and candidates of each
UNIT = 32767        # stored vectors are multiples of 1 / UNIT
PART = 1 << 24      # what is left of a vector is added up in multiples of 1 / PART
ROWS = 512          # texts judged at once in a task
NAMES = ("mix_source", "mix_lang", "mix_topic")
Cell = tuple[str, str, str]


@dataclass(frozen=True)
class Targets:
    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]


# --- topics -------------------------------------------------------------------------------------------------

def word_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of damped hashed word counts, words per text)."""
    out, sizes, places = np.zeros((len(texts), WIDTH)), np.zeros(len(texts), dtype=np.int64), {}
    for row, text in enumerate(texts):
        words = text.lower().split()
        sizes[row] = len(words)
        if words:
            at = [places[w] if w in places else places.setdefault(w, zlib.crc32(w) % WIDTH) for w in words]
            out[row] = np.bincount(at, minlength=WIDTH)
            if len(places) > 50_000:
                places.clear()
    out = np.log1p(out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.rint(np.divide(out, norms, out=out, where=norms > 0) * UNIT) / UNIT, sizes


class TopicModel:
    """Means per language and centroids of what is left of a text without its language."""

    def __init__(self, means: dict[str, np.ndarray], everywhere: np.ndarray, centroids: np.ndarray) -> None:
        self.means, self.everywhere, self.centroids = means, everywhere, centroids

    def rest(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        return vectors - np.array([self.means.get(x, self.everywhere) for x in langs]).reshape(len(langs), WIDTH)

    def names(self, texts: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
        """Topic and number of words of every text."""
        vectors, sizes = word_vectors(texts)
        return self.named(vectors, sizes, langs), sizes

    def named(self, vectors: np.ndarray, sizes: np.ndarray, langs: list[str]) -> list[str]:
        near = np.rint(self.rest(vectors, langs) @ self.centroids.T * 1e9)
        nearest = near.argmax(axis=1) if len(self.centroids) else np.zeros(len(vectors), dtype=int)
        return [f"topic{k}" if n else EMPTY for k, n in zip(nearest, sizes)]


def fit_topics(vectors: np.ndarray, langs: list[str], topics: int = TOPICS) -> TopicModel:
    """Spherical k-means from farthest-first centres; a language needs 20 texts for a mean of its own."""
    filled = vectors.any(axis=1)
    vectors, langs = vectors[filled], np.array(langs, dtype=object)[filled]
    if not len(vectors):
        return TopicModel({}, np.zeros(WIDTH), np.zeros((0, WIDTH)))
    means = {x: vectors[langs == x].mean(axis=0) for x in sorted(set(langs)) if (langs == x).sum() >= 20}
    model = TopicModel(means, vectors.mean(axis=0), np.zeros((0, WIDTH)))
    rest = _unit(model.rest(vectors, list(langs)))
    model.centroids = _by_size(*_grouped(rest, np.ones(len(rest)), topics))
    return model


def _unit(rest: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rest, axis=1, keepdims=True)
    return np.divide(rest, norms, out=np.zeros_like(rest), where=norms > 1e-9)


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The directions of the sums; a centre whose sum is zero stays."""
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)


def _by_size(centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return centres[np.argsort(-sizes, kind="stable")]


def _grouped(rest: np.ndarray, weights: np.ndarray, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, their weights) of weighted unit rows: spherical k-means from the heaviest row and those of most weighted distance."""
    picks = [int(weights.argmax())]
    best = rest @ rest[picks[0]]
    while len(picks) < min(topics, len(rest)) and best.min() < 1 - 1e-9:
        picks.append(int((weights * (1 - best)).argmax()))
        best = np.maximum(best, rest @ rest[picks[-1]])
    centres = rest[picks]
    for _ in range(ROUNDS):
        owner = (rest @ centres.T).argmax(axis=1)
        centres = _moved(centres, np.array([(rest[owner == k] * weights[owner == k, None]).sum(axis=0) for k in range(len(centres))]))
    return centres, np.bincount((rest @ centres.T).argmax(axis=1), weights, len(centres))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(OTHER))


def _places(docs: DataFrame, *kept: Column) -> DataFrame:
    """The ``kept`` columns, source, language, draw and text."""
    text = text_or_empty().cast("string")
    return docs.select(*kept, F.coalesce(F.col("source").cast("string"), F.lit(OTHER)).alias("mix_source") if "source" in docs.columns else F.lit(OTHER).alias("mix_source"),
                       _lang().alias("mix_lang"), unit_draw(F.col("doc_id").cast("long"), text, seed=SEED).alias("mix_draw"), text.alias("mix_text"))


def word_table(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept``, mix_source, mix_lang, mix_draw, mix_words and mix_vector (16-bit numbers) of every row; written once."""
    rows = _places(docs, *kept)
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                vectors, sizes = word_vectors(utf8(part.column("mix_text")))
                found = np.rint(vectors * UNIT).astype("<i2")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes), pa.array([x.tobytes() for x in found], pa.binary())],
                                                 [*names, "mix_words", "mix_vector"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return written(rows.mapInArrow(run, ", ".join([*kinds, "mix_words long", "mix_vector binary"])), "mixing-vectors")


def _stored(vectors: pa.Array) -> np.ndarray:
    """The whole numbers of the vectors of a word table."""
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype="<i2").reshape(len(vectors), WIDTH).astype(float)


def _total(rows: DataFrame, key: str, kind: str, sums) -> dict:
    """{key: (rows, vector sum)} over all rows; ``sums`` gives (key, rows, whole numbers) of a batch, which tasks add up first."""
    def run(batches):
        total = {}
        for batch in batches:
            for part in slices(batch, 4 * ROWS):
                for k, n, v in sums(part):
                    known = total.get(k)
                    total[k] = (n, v) if known is None else (known[0] + n, known[1] + v)
        if total:
            at = pa.array(np.arange(len(total) + 1, dtype=np.int32) * (WIDTH + 1))
            flat = pa.array(np.concatenate([np.append(v, n) for n, v in total.values()]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string() if kind == "string" else pa.int64()), pa.ListArray.from_arrays(at, flat)], [key, "v"])

    parts = rows.mapInArrow(run, f"{key} {kind}, v array<long>").select(key, F.posexplode("v").alias("at", "x"))
    found: dict = {}
    for r in parts.groupBy(key, "at").agg(F.sum("x").alias("x")).collect():     # one vector per language or centroid
        found.setdefault(r[key], np.zeros(WIDTH + 1))[r["at"]] = r["x"]
    return {k: (int(v[WIDTH]), v[:WIDTH]) for k, v in sorted(found.items())}


def topic_model(docs: DataFrame) -> TopicModel:
    """Fitted on all rows with words; only sums and drawn candidates reach the driver."""
    return fitted(word_table(docs))


def fitted(table: DataFrame) -> TopicModel:
    """The topic model of a word table."""
    rows = table.where("mix_words > 0").select(F.col("mix_lang").alias("lang"), F.col("mix_vector").alias("v"), "mix_draw")

    def by_lang(part: pa.RecordBatch):
        vectors, langs = _stored(part.column("v")).astype(np.int64), part.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        return [(x, int((codes == i).sum()), vectors[codes == i].sum(axis=0)) for i, x in enumerate(langs.dictionary.to_pylist())]

    sums = _total(rows, "lang", "string", by_lang)
    if not sums:
        return fit_topics(np.zeros((0, WIDTH)), [])
    count = sum(n for n, _ in sums.values())
    model = TopicModel({x: v / n / UNIT for x, (n, v) in sums.items() if n >= 20}, sum(v for _, v in sums.values()) / count / UNIT, np.zeros((0, WIDTH)))

    def rest(part: pa.RecordBatch) -> np.ndarray:
        return _unit(model.rest(_stored(part.column("v")) / UNIT, part.column("lang").to_pylist()))

    def owned(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, vector sum) of every centre over all rows."""
        def sums(part: pa.RecordBatch):
            left = rest(part)
            owner = (left @ centres.T).argmax(axis=1)
            whole = np.rint(left * PART).astype(np.int64)
            return [(int(k), int((owner == k).sum()), whole[owner == k].sum(axis=0)) for k in np.unique(owner)]

        got = _total(rows, "k", "long", sums)
        sizes, total = np.zeros(len(centres)), np.zeros(centres.shape)
        for k, (n, v) in got.items():
            sizes[k], total[k] = n, v
        return sizes, total / PART

    found = np.zeros((0, WIDTH))
    for step in range(DRAWS):       # the first draw is even, the others prefer rows far from what was drawn before
        new = _drawn(rows, rest, found, step)
        if not len(new):
            break
        found = np.concatenate([found, new])
    if not len(found):      # every text is its language's mean
        return model
    centres, _ = _grouped(found, owned(found)[0], TOPICS)
    for _ in range(ROUNDS):
        sizes, total = owned(centres)
        before, centres = centres, _moved(centres, total)
        if (before == centres).all():
            break
    model.centroids = _by_size(centres, owned(centres)[0])
    return model


def _drawn(rows: DataFrame, rest, found: np.ndarray, step: int) -> np.ndarray:
    """``DRAWN`` of all rows, drawn in proportion to their distance from ``found``: those of the smallest -log(draw) / distance."""
    draw = unit_draw("mix_draw", seed=SEED + 1 + step)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4 * ROWS):
                left = rest(part)
                far = np.rint((1 - (left @ found.T).max(axis=1) if len(found) else np.ones(len(left))) * 1e9) / 1e9
                far[~left.any(axis=1)] = 0
                key = np.divide(-np.log(np.maximum(part.column("draw").to_numpy(), 1e-300)), far, out=np.full(len(left), np.inf), where=far > 0)
                best = np.argsort(key, kind="stable")[:DRAWN * 8]
                best = best[key[best] < np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(key[best]), pa.array([np.rint(left[i] * PART).astype("<i8").tobytes() for i in best], pa.binary())], ["key", "v"])

    got = rows.select("lang", "v", draw.alias("draw")).mapInArrow(run, "key double, v binary").distinct().orderBy("key", "v").limit(DRAWN).collect()
    return _unit(np.array([np.frombuffer(r["v"], dtype="<i8") for r in got], dtype=float).reshape(len(got), WIDTH))


def placed(docs: DataFrame, model: TopicModel, *kept: Column) -> DataFrame:
    """The ``kept`` columns and the columns that place a row: source, language, topic, tokens and draw."""
    @F.arrow_udf("topic string, tokens long")
    def judged(texts: pa.Array, langs: pa.Array) -> pa.Array:
        names, sizes = [], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(texts), ROWS):
            some, words = model.names(utf8(texts.slice(start, ROWS)), langs.slice(start, ROWS).to_pylist())
            names += some
            sizes.append(words)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.maximum(np.concatenate(sizes), 1))], ["topic", "tokens"])

    return _places(docs, *kept).withColumn("mix_judged", judged("mix_text", "mix_lang")).select(
        "*", F.col("mix_judged.topic").alias("mix_topic"), F.col("mix_judged.tokens").alias("mix_tokens")).drop("mix_judged", "mix_text")


def placed_table(table: DataFrame, model: TopicModel) -> DataFrame:
    """Topic and tokens of a word table's rows, from the written vectors."""
    @F.arrow_udf("string")
    def named(vectors: pa.Array, words: pa.Array, langs: pa.Array) -> pa.Array:
        names = []
        for start in range(0, len(vectors), ROWS):
            cut = [x.slice(start, ROWS) for x in (vectors, words, langs)]
            names += model.named(_stored(cut[0]) / UNIT, cut[1].to_numpy(zero_copy_only=False), cut[2].to_pylist())
        return pa.array(names, pa.string())

    return table.withColumn("mix_topic", named("mix_vector", "mix_words", "mix_lang")).withColumn("mix_tokens", F.greatest("mix_words", F.lit(1))).drop("mix_words", "mix_vector")


# --- raking -------------------------------------------------------------------------------------------------

class Cells:
    """Cells as arrays: their tokens, and per axis the values and each cell's place among them."""

    def __init__(self, tokens: dict[Cell, float]) -> None:
        self.keys = sorted(tokens)
        self.n = np.array([float(tokens[k]) for k in self.keys])
        self.values, self.codes = [], []
        for axis in range(3):
            values, codes = np.unique(np.array([k[axis] for k in self.keys], dtype=object), return_inverse=True)
            self.values.append(list(values)), self.codes.append(codes)

    def sums(self, axis: int, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.codes[axis], x, len(self.values[axis]))


def rake(tokens: dict[Cell, float], targets: Targets) -> dict[Cell, float]:
    """Share of each cell after raking; the shares sum to 1."""
    cells = Cells(tokens)
    if not cells.keys:
        return {}
    share = cells.n / cells.n.sum()
    goals = []
    for axis, wanted in enumerate((targets.source, targets.lang, targets.topic)):
        now, values = cells.sums(axis, share), cells.values[axis]
        free = sum(now[i] for i, v in enumerate(values) if v not in wanted)
        named = sum(wanted[v] for v in values if v in wanted)
        goals.append(np.array([now[i] if v not in wanted or not named else (1 - free) * wanted[v] / named for i, v in enumerate(values)]))
    for _ in range(SWEEPS):
        before = share
        for axis, goal in enumerate(goals):
            now = cells.sums(axis, share)
            share = share * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[cells.codes[axis]]
        share = share / share.sum() if share.sum() else before
        if np.abs(share - before).max() < TOLERANCE:
            break
    return dict(zip(cells.keys, share))


def filled(weight: np.ndarray, room: np.ndarray, code: np.ndarray, total: np.ndarray) -> np.ndarray:
    """min(room, scale * weight) with one scale per group at which the group sums to its total, or as near as there is room.

    Sorted by the scale at which they fill up, the cells before a place of a group are full and the others are not; the place where the sum passes the total gives the scale.
    """
    limit = np.divide(room, weight, out=np.full(len(room), np.inf), where=weight > 0)
    order = np.lexsort((limit, code))
    c, w, r, at = code[order], weight[order], room[order], limit[order]
    start = np.searchsorted(c, np.arange(len(total)))

    def inside(x: np.ndarray) -> np.ndarray:
        """Running sums within the group, up to and with each cell."""
        run = np.cumsum(x)
        return run - np.concatenate([[0.0], run])[start][c]

    full, mass = inside(r), inside(w)
    all_mass = np.bincount(code, weight, len(total))
    left = np.maximum(all_mass[c] - mass, 0.0)
    reached = np.where(at < np.inf, full + np.where(at < np.inf, at, 0.0) * left, np.inf)
    whole = np.bincount(c[reached <= total[c]], minlength=len(total))       # cells of a group that are full
    last = start + whole - 1
    used = np.where(whole > 0, full[np.maximum(last, 0)], 0.0)
    rest = np.where(whole > 0, left[np.maximum(last, 0)], all_mass)
    scale = np.divide(np.maximum(total - used, 0.0), rest, out=np.zeros(len(total)), where=rest > 0)
    place = np.arange(len(c)) - start[c]
    out = np.empty(len(c))
    out[order] = np.where(place < whole[c], r, np.minimum(r, w * scale[c]))
    return out


def probabilities(tokens: dict[Cell, float], share: dict[Cell, float], budget: float = BUDGET) -> dict[Cell, float]:
    """Probability of each cell, with ``budget`` of all tokens expected in the margins of ``share`` as far as there are tokens."""
    cells = Cells(tokens)
    if not cells.keys:
        return {}
    n, wanted, one = cells.n, np.array([share[k] for k in cells.keys]), np.zeros(len(cells.keys), dtype=int)
    want = min(1.0, budget) * n.sum()
    kept = filled(wanted, n, one, np.array([want]))
    goals = []
    for axis in range(3):
        margin = cells.sums(axis, wanted)
        goals.append(filled(margin, cells.sums(axis, n), np.zeros(len(margin), dtype=int), np.array([want])))
    for _ in range(SWEEPS):
        before = kept
        for axis, goal in enumerate(goals):
            kept = filled(kept, n, cells.codes[axis], goal)
        if np.abs(kept - before).max() < TOLERANCE * n.sum():
            break
    return dict(zip(cells.keys, np.clip(filled(kept, n, one, np.array([want])) / n, 0, 1).tolist()))


def present_targets(tokens: dict[Cell, float]) -> Targets:
    """Equal shares for the sources that occur; for languages and topics shares by the square root of their tokens."""
    cells = Cells(tokens)

    def shares(axis: int, weight: np.ndarray) -> dict[str, float]:
        kept = [(v, w) for v, w in zip(cells.values[axis], weight) if v not in (OTHER, EMPTY)]
        return {v: float(w / sum(x for _, x in kept)) for v, w in kept}

    return Targets(shares(0, np.ones(len(cells.values[0]))), *(shares(axis, np.sqrt(cells.sums(axis, cells.n))) for axis in (1, 2)))


def plan(rows: DataFrame, targets: Targets | None, budget: float) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, mix_weight, mix_probability): one row per cell."""
    got = rows.groupBy(*NAMES).agg(F.sum("mix_tokens").alias("n")).limit(MAX_CELLS + 1).collect()   # one row per cell
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    tokens = {(r.mix_source, r.mix_lang, r.mix_topic): r.n for r in got}
    share = rake(tokens, targets or present_targets(tokens))
    total = sum(tokens.values())
    kept = probabilities(tokens, share, budget)
    found = [(*k, float(share[k] * total / tokens[k]), float(kept[k])) for k in sorted(tokens)]
    return rows.sparkSession.createDataFrame(found, ", ".join(f"{n} string" for n in NAMES) + ", mix_weight double, mix_probability double")


def mix(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept: one row per row of ``docs``."""
    table = word_table(docs, F.col("doc_id"))
    rows = placed_table(table, fitted(table))
    return rows.join(small_side(plan(rows, targets, budget)), list(NAMES)).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"),
        (F.col("mix_draw") < F.col("mix_probability")).alias("kept"))


def sample(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET) -> DataFrame:
    """The kept rows of ``docs``, all columns."""
    table = word_table(docs)
    model = fitted(table)
    rows = placed(docs, model, *[F.col(f"`{c}`") for c in docs.columns])
    return (rows.join(small_side(plan(placed_table(table, model), targets, budget)), list(NAMES)).where("mix_draw < mix_probability")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
