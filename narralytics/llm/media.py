"""Media columns by content-defined chunking.

A text becomes an 8-bit mono PCM sound (a RIFF/WAVE file): its UTF-8 bytes, padded with blanks to a positive
multiple of 192, are the samples. The stored file is cut where a rolling gear hash of the last 32 bytes has its
high bits clear, so equal passages give equal chunks wherever they stand. Chunk digests are grouped and
joined by Spark: a digest that occurs once stays beside its media, one that occurs more often is stored
once in a chunk table. Reading back puts each media together from its ordered chunk list, compares the
SHA-256 of the whole with the recorded one and only then computes features.

Bytes are moved only for shared chunks. Which digests are shared is told to the writing tasks by a bit map
with ``BITS_PER_CHUNK`` bits for each shared digest, 2 to 32 MB; a digest that hits a bit by chance is treated as shared,
which costs a move and changes no result.

Defined results: null is the empty text; equal texts give equal values; repeated rows and repeated doc_ids
give a row each; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import slices, utf8, written
from narralytics.session import scratch_path

UNIT = 192
RATE = 8000
WINDOW = 32
CUT_MASK = np.uint32(0xFFF00000)   # 12 bits: chunks of 4 KiB on average
MIN_CHUNK, MAX_CHUNK = 512, 65536
BITS_PER_CHUNK = 16
LEAST_BITS, MOST_BITS = 24, 28     # logarithm of the map's size
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode(samples: bytes) -> bytes:
    """RIFF/WAVE file of 8-bit mono samples."""
    head = b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples


def decode(media: bytes) -> bytes:
    """The samples of a file written by ``encode``."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit sound of this library")
    samples = media[44:]
    if struct.unpack("<I", media[40:44])[0] != len(samples):
        raise ValueError("the sound is cut short")
    return samples


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks; a cut depends on the 32 bytes before it and on the chunk's least and largest size."""
    value = _GEAR[np.frombuffer(media, dtype=np.uint8)]
    span = 1
    while span < WINDOW:  # value[i] becomes the gear hash of the last 2 * span bytes
        longer = value.copy()
        longer[span:] += value[:-span] << np.uint32(span)
        value, span = longer, 2 * span
    ends, start = [], 0
    for at in np.flatnonzero((value & CUT_MASK) == 0) + 1:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK and at < len(media):
            ends.append(int(at))
            start = int(at)
    while len(media) - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return [*ends, len(media)]


def chunks(media: bytes) -> list[bytes]:
    ends = cut_points(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Mean, deviation, peak and zero crossings of the samples, and a 16-band energy profile."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = [int(np.abs(part).sum()) for part in np.array_split(x, 16)]
    mean = int(x.sum()) / len(x)
    deviation = max(0.0, int((x * x).sum()) / len(x) - mean * mean) ** 0.5
    return f"mean={mean:.4f};sd={deviation:.4f};peak={int(np.abs(x).max())};zc={crossings};bands=" + ",".join(map(str, bands))


def _bit(of: bytes, bits: int) -> int:
    return int.from_bytes(of[:4], "big") >> (32 - bits)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """The ordered chunk digests of every row's media."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                listed = [[digest(c) for c in chunks(encode(payload(t)))] for t in utf8(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(listed, pa.list_(pa.binary()))], ["chunks"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "chunks array<binary>")


def map_bits(shared: int) -> int:
    """Logarithm of the size of the map for so many shared digests."""
    return min(MOST_BITS, max(LEAST_BITS, (shared * BITS_PER_CHUNK - 1).bit_length()))


def shared_map(listed: DataFrame) -> tuple[np.ndarray, int]:
    """Bit map of the digests that occur more than once among all chunk lists, and the logarithm of its size."""
    seen = listed.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = written(seen.selectExpr("CAST(conv(hex(substring(chunk, 1, 4)), 16, 10) AS BIGINT) AS head"), "shared-heads")
    bits = map_bits(heads.count())
    at = heads.selectExpr(f"shiftrightunsigned(head, {32 - bits}) AS at")
    words = at.selectExpr("at div 64 AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << bits) // 64, dtype=np.uint64)
    got = words.toArrow()       # at most 2 ** MOST_BITS / 64 rows
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out, bits


STORED = "kind string, doc_id long, n_bytes long, media_sha256 string, parts array<struct<digest: binary, blob: binary>>"
_PARTS = pa.list_(pa.struct([("digest", pa.binary()), ("blob", pa.binary())]))
_STORED_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), _PARTS)


def store(docs: DataFrame, path: str) -> None:
    """Write ``path``/written/kind=media (a row per document, unshared chunks inside) and ``path``/chunks (shared ones, once)."""
    made, bits = shared_map(chunk_lists(docs))
    told = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        shared = told.value
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, 512):
                rows, common = [], {}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                    media, parts = encode(payload(text)), []
                    for chunk in chunks(media):
                        name = digest(chunk)
                        at = _bit(name, bits)
                        hit = int(shared[at // 64]) >> (at % 64) & 1
                        if hit:
                            common[name] = chunk
                        parts.append({"digest": name, "blob": None if hit else pack(chunk)})
                    rows.append(("media", doc_id, len(text), hashlib.sha256(media).hexdigest(), parts))
                rows += [("chunk", None, None, None, [{"digest": n, "blob": pack(c)}]) for n, c in common.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(_STORED_TYPES)],
                    ["kind", "doc_id", "n_bytes", "media_sha256", "parts"])

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED).write.partitionBy("kind").parquet(f"{path}/written")
    raw = _stored(docs.sparkSession, path, "chunk").select(F.col("parts")[0].digest.alias("chunk"), F.col("parts")[0].blob.alias("blob"))
    raw.groupBy("chunk").agg(F.max("blob").alias("blob")).write.parquet(f"{path}/chunks")


def _stored(spark, path: str, kind: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{path}/written").where(F.col("kind") == kind)


MEASURED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(),
            "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def read_back(stored: DataFrame) -> DataFrame:
    """Verify and measure media rows (doc_id, n_bytes, media_sha256, parts) whose chunks are all present."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, 512):
                out = []
                for doc_id, n_bytes, sha, parts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_sha256", "parts"))):
                    media = b"".join(unpack(p["blob"]) for p in parts)
                    if hashlib.sha256(media).hexdigest() != sha:
                        raise ValueError(f"media {sha} differs from what was stored")
                    samples = decode(media)
                    out.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
                                len(media), sha, features(samples)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate(MEASURED.values())], list(MEASURED))

    return stored.mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in MEASURED.items()))


def measure(docs: DataFrame) -> DataFrame:
    """Store the media of every row, read them back and return their digests and features."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media-store")
    store(docs, path)
    media = _stored(spark, path, "media").drop("kind")
    whole = ~F.exists("parts", lambda p: p.blob.isNull())
    # media with shared chunks: each distinct one is put together once
    lists = media.where(~whole).groupBy("media_sha256").agg(F.max("parts").alias("parts"))
    refs = lists.select("media_sha256", F.posexplode("parts").alias("seq", "p")).select(
        "media_sha256", "seq", F.col("p.digest").alias("chunk"), F.col("p.blob").alias("own"))
    kept = spark.read.schema("chunk binary, blob binary").parquet(f"{path}/chunks")
    filled = (refs.where("own IS NULL").drop("own").join(kept, "chunk")
              .unionByName(refs.where("own IS NOT NULL").withColumnRenamed("own", "blob")))
    joined = filled.groupBy("media_sha256").agg(F.sort_array(F.collect_list(F.struct(
        "seq", F.struct(F.col("chunk").alias("digest"), "blob").alias("part")))).alias("parts"))
    none = F.lit(None).cast("long")
    rebuilt = written(read_back(joined.select(none.alias("doc_id"), none.alias("n_bytes"), "media_sha256",
                                              F.transform("parts", lambda p: p.part).alias("parts"))), "media-features")
    rows = media.where(~whole).select("doc_id", "n_bytes", "media_sha256")
    shared_rows = rows.join(rebuilt.drop("doc_id", "n_bytes"), "media_sha256")
    return read_back(media.where(whole)).unionByName(shared_rows).select(*MEASURED)
