"""Language-model scoring by cross-entropy difference, with word bigrams.

Two interpolated word bigram models, one of the target texts and one of the background corpus, share the vocabulary of
all words of both tables, without a limit. Words are lower-cased runs of letters, marks and digits, single
ideographs and single signs; the end of a text is a token, its start only a context. The models are matched by order,
vocabulary and smoothing mass; the counts of both enter as they are. A document's score is the mean over its tokens of
target loss minus background loss, in bits; low means like the target.

Counting. Texts are tokenised once and packed into chunks of about ``CHUNK_TOKENS`` tokens: the chunk's words and its tokens as places among
them. What is counted, bigrams and words, is an item with a 64-bit number. A chunk sends its distinct items with their counts, sorted and
delta-coded, to shards that are ranges of the item number; so an item that stands in a third of all texts is one entry per chunk, and
no token travels as a row. A shard adds up the counts and sends each chunk the totals of the items it asked for, in the order it sent them. The chunk then
scores its own texts. Chunks, entries of a shard and answers are bounded; only the totals of the models reach the driver. Tables of a
step are deleted when the next stands.

Defined results: a null or empty text has one token (its end); repeated rows are counted and scored each; an
empty target or background gives a uniform model; an empty table of documents gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import text_or_empty
from narralytics.session import Scratch, spread, stored

MASS = 16.0               # pseudo-counts that a context gets from the next shorter one
START, END = 0, 1
WORD = r"\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+|[^\s\p{L}\p{M}\p{N}]"
CHUNK_TOKENS = 1 << 20    # a longer text is a chunk of its own
SHARD_ITEMS = 1 << 21     # tokens per shard of the counts
CHUNKS = "chunk long, target boolean, docs array<long>, sizes array<int>, words binary, places binary"
ENTRIES = "shard long, chunk long, target boolean, n int, items binary, counts binary"
TOTALS = "shard long, chunk long, t binary, b binary, words long, t_tokens long, b_tokens long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def words(text: Column) -> Column:
    """array<long>: the hashed words of a text and its end."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.concat(F.transform(found, lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("long")))


# --- packing ------------------------------------------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, in as many bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(pa.decompress(blob[1:], n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Items:
    """The distinct bigrams and words of a chunk, sorted: word items are odd, bigram items even."""

    def __init__(self, word: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        token, before = word[places], np.empty(len(places), dtype=np.uint64)
        before[1:] = token[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts] = START
        even = np.uint64(0xFFFFFFFFFFFFFFFE)
        grams, gram_of, gram_n = np.unique(_mixed(_mixed(before + np.uint64(0x9E3779B97F4A7C15)) ^ token) & even, return_inverse=True, return_counts=True)
        single = _mixed(word) | np.uint64(1)
        both = np.concatenate([grams, single])
        order = np.argsort(both, kind="stable")
        at = np.empty(len(both), dtype=np.int64)
        at[order] = np.arange(len(both))
        self.items = both[order]
        self.counts = np.concatenate([gram_n, np.bincount(places, minlength=len(word))])[order].astype(np.uint64)
        self.gram_at = at[:len(grams)][gram_of]                 # per token, where its bigram stands
        self.word_at = at[len(grams):][places]                  # per token, where its word stands
        self.starts = starts

    def slices(self, bits: int):
        """(shard, from, to) of the items by their highest bits."""
        edges = np.searchsorted(self.items, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([edges, [len(self.items)]])
        starts = np.concatenate([[0], edges])
        for shard in np.flatnonzero(ends > starts):
            yield int(shard), int(starts[shard]), int(ends[shard])


def _open(row: dict) -> Items:
    sizes = np.array(row["sizes"], dtype=np.int64)
    places = unpack(row["places"], int(sizes.sum())).astype(np.int64)
    return Items(np.frombuffer(row["words"], dtype=np.uint64), places, sizes)


# --- the steps ----------------------------------------------------------------------------------------------

def chunks(texts: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Packed chunks of (target, doc_id, s), in the order in which a task meets its rows."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        docs: list = []
        side = False

        def packed():
            nonlocal number
            word, places = np.unique(np.concatenate(held), return_inverse=True)
            row = [number, side, list(docs), [len(h) for h in held], word.tobytes(), pack(places.astype(np.uint64))]
            number += 1
            held.clear(), docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (
                pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()))],
                ["chunk", "target", "docs", "sizes", "words", "places"])

        for batch in batches:
            for doc, target, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("target").to_pylist(), batch.column("s")):
                found = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if held and (target != side or total + len(found) > chunk_tokens):
                    yield packed()
                if not held:
                    total, side = 0, target
                held.append(found)
                docs.append(doc)
                total += len(found)
        if held:
            yield packed()

    return texts.select("doc_id", "target", "s").mapInArrow(run, CHUNKS)


def entries(packed: DataFrame, bits: int) -> DataFrame:
    """What the chunks ask: per shard their items and counts."""
    def run(batches):
        for batch in batches:
            for row in batch.select(["chunk", "target", "sizes", "words", "places"]).to_pylist():
                own = _open(row)
                rows = [(shard, row["chunk"], row["target"], b - a, pack_sorted(own.items[a:b]), pack(own.counts[a:b])) for shard, a, b in own.slices(bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "chunk", "target", "n", "items", "counts"])

    return packed.mapInArrow(run, ENTRIES)


def totals(asked: DataFrame) -> DataFrame:
    """The answers of the shards: per chunk the totals of its items on both sides; one more row per shard, without chunk, sums its words."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        each = [unpack_sorted(r["items"], r["n"]) for r in rows]
        found, where = np.unique(np.concatenate(each), return_inverse=True)
        counts = [unpack(r["counts"], r["n"]) for r in rows]
        t, b = (np.bincount(where, np.concatenate([c * np.uint64(r["target"] == side) for r, c in zip(rows, counts)]).astype(float), len(found)).astype(np.uint64)
                for side in (True, False))
        word = (found & np.uint64(1)).astype(bool)
        shard = rows[0]["shard"]
        out = [(shard, None, None, None, int(word.sum()), int(t[word].sum()), int(b[word].sum()))]
        ends = np.cumsum([r["n"] for r in rows])
        for r, end in zip(rows, ends):
            if not r["target"]:
                mine = where[end - r["n"]:end]
                out.append((shard, r["chunk"], pack(t[mine]), pack(b[mine]), None, None, None))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["shard", "chunk", "t", "b", "words", "t_tokens", "b_tokens"])

    return spread(asked, "shard").groupBy("shard").applyInArrow(run, TOTALS)


def scores(packed: DataFrame, answers: DataFrame, bits: int, size: int, tokens: tuple[int, int], texts: tuple[int, int]) -> DataFrame:
    """doc_id, n_tokens and the mean losses of every text of the chunks."""
    def loss(gram, word, context, total: int) -> np.ndarray:
        shorter = (word + MASS / max(1, size)) / (total + MASS)
        return -np.log2((gram + MASS * shorter) / (context + MASS))

    def run(chunk: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            own, sizes = _open(row), np.array(row["sizes"], dtype=np.int64)
            answer = {r["shard"]: r for r in parts.select(["shard", "t", "b"]).to_pylist()}
            means = []
            for side in (0, 1):
                count = np.concatenate([unpack(answer[shard]["tb"[side]], b - a) for shard, a, b in own.slices(bits)]).astype(float)
                word = count[own.word_at]
                context = np.empty(len(word))
                context[1:] = word[:-1]
                context[own.starts] = texts[side]
                means.append(np.add.reduceat(loss(count[own.gram_at], word, context, tokens[side]), own.starts) / sizes)
            out.append(pa.Table.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(sizes), pa.array(means[0]), pa.array(means[1])],
                                            ["doc_id", "n_tokens", "target_loss", "background_loss"]))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()),
                                                             ("background_loss", pa.float64())]).empty_table()

    mine = spread(packed.where(~F.col("target")).select("chunk", "docs", "sizes", "words", "places"), "chunk")
    return mine.groupBy("chunk").cogroup(spread(answers.where("chunk IS NOT NULL").select("chunk", "shard", "t", "b"), "chunk").groupBy("chunk")).applyInArrow(run, SCORES)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, chunk_tokens: int = CHUNK_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference: every row of ``docs`` scored with the target
    texts against all of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    s = words(text_or_empty().cast("string")).alias("s")
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("target"), s).unionAll(
        target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("target"), s))
    packed = scratch.write(chunks(both, chunk_tokens), "lm-chunks")
    counted = {r["target"]: (r["texts"], r["tokens"]) for r in packed.groupBy("target").agg(
        F.sum(F.size("sizes")).alias("texts"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, n: x + n)).alias("tokens")).collect()}
    texts = tuple(counted.get(side, (0, 0))[0] for side in (True, False))
    bits = max(0, (sum(n for _, n in counted.values()) // shard_items).bit_length())
    answers = scratch.write(totals(entries(packed, bits)), "lm-totals")
    size, *tokens = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "t_tokens", "b_tokens")]).first()
    found = stored(scores(packed, answers, bits, size, tuple(tokens), texts), "lm-scores")
    scratch.clear()
    return found.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))
