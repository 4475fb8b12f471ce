"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never end up in one token, so the text may be
cut between them and the fragments encoded on their own. ``cut_table`` derives these pairs from the
vocabulary (special tokens included). Only cuts that also leave normalisation and the splitting into words
untouched are used: both bytes are ASCII, and they differ in kind (letter, digit, sign, blank) or are
digits; or the second is an ASCII blank after a character above ASCII that is no blank itself. Fragments repeat a lot, so each task keeps a bounded table of the ones it has encoded.

Defined results: null is the empty text, with no ids and an empty decoded text; repeated rows are encoded alike;
an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narralytics.llm.common import slices, utf8

VOCABULARY = "word_bpe_49k.json"
CACHED_FRAGMENTS = 400_000
CACHED_BYTES = 64        # longer fragments are not kept
# fixed values: the blanks above ASCII
BLANKS = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_CODES = np.array([int.from_bytes(c.encode()[-3:], "big") for c in BLANKS])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _kind(byte: int) -> str:
    c = chr(byte)
    return "blank" if c in " \t\n\r\x0b\x0c" else "letter" if c.isalpha() else "digit" if c.isdigit() else "sign"


@lru_cache(maxsize=2)
def cut_table(path: str) -> np.ndarray:
    """table[a, b]: a cut between bytes a and b is certain and leaves the words as they are."""
    made = tokenizer(path)
    seen = np.zeros((256, 256), dtype=bool)
    inside = [t.removesuffix("</w>") for t in made.get_vocab(with_added_tokens=False)]
    inside += [t.content for t in made.get_added_tokens_decoder().values()]
    for token in inside:
        raw = token.encode()
        for a, b in zip(raw, raw[1:]):
            seen[a, b] = True
    lower = lambda byte: byte + 32 if 65 <= byte <= 90 else byte
    table = np.zeros((256, 256), dtype=bool)
    for a in range(128):
        for b in range(128):
            kinds = _kind(a), _kind(b)
            apart = kinds[0] != kinds[1] or kinds == ("digit", "digit")
            # a blank starts a fragment and stays with the word after it
            table[a, b] = apart and kinds[0] != "blank" and not seen[lower(a), lower(b)] and not seen[a, b]
    for a in range(128, 256):      # no letter composes with the blank after it
        for b in b" \t\n\r\x0b\x0c":
            table[a, b] = not seen[a, b]
    return table


def fragments(text: bytes, table: np.ndarray) -> list[bytes]:
    raw = np.frombuffer(text, dtype=np.uint8)
    cuts = np.flatnonzero(table[raw[:-1], raw[1:]]) + 1
    high = raw[cuts - 1] >= 128
    if high.any():      # a blank above ASCII stays with the blanks after it
        two = raw[cuts - 2].astype(int) << 8 | raw[cuts - 1]
        blank = np.isin(two, _BLANK_CODES) | np.isin(raw[np.maximum(cuts - 3, 0)].astype(int) << 16 | two, _BLANK_CODES)
        cuts = cuts[~(high & blank)]
    cuts = cuts.tolist()
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []


class Codec:
    """Encodes fragments once; a fragment maps to its ids (little-endian bytes) and its decoded text.

    Where the vocabulary is lower-case anyway, ASCII capitals are lowered first, unless a byte
    above ASCII follows (NFC comes before lowering) or the text could then hold a special token it does not hold now.
    """

    def __init__(self, path: str):
        self.made, self.table, self.known = tokenizer(path), cut_table(path), {}
        size = self.made.get_vocab_size(with_added_tokens=True)
        self.names = [(self.made.id_to_token(i) or "").encode() for i in range(size)]
        self.special = [t.content.lower().encode() for t in self.made.get_added_tokens_decoder().values()]
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lowers = self.made.normalizer is not None and self.made.normalizer.normalize_str(capitals) == capitals.lower()

    def _decoded(self, ids: list[int]) -> bytes:
        if self.made.decoder is None:  # such a tokenizer decodes to its tokens, joined by blanks
            return b" ".join([self.names[i] for i in ids])
        return self.made.decode(ids, skip_special_tokens=False).encode()

    def _lowered(self, text: bytes) -> bytes:
        low = text.lower() if self.lowers else text
        if low is text or any(s in low for s in self.special):
            return text
        if text.isascii():
            return low
        raw = np.frombuffer(text, dtype=np.uint8)   # a capital before a mark may compose with it, so it stays
        capital = (raw >= 65) & (raw <= 90)
        capital[:-1] &= raw[1:] < 128
        return (raw + (capital * 32).astype(np.uint8)).tobytes()

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as bytes, decoded text) per text; decoded fragments are joined as the library joins tokens."""
        cut = [fragments(self._lowered(t), self.table) for t in texts]
        known, long = self.known, []
        new = [f for f in set().union(*cut) if f not in known]
        for start in range(0, len(new), 4096):
            some = new[start:start + 4096]
            for f, e in zip(some, self.made.encode_batch_fast([f.decode() for f in some], add_special_tokens=False)):
                ids = e.ids
                known[f] = (struct.pack(f"<{len(ids)}I", *ids), b" " + self._decoded(ids) if ids else b"")
                if len(f) > CACHED_BYTES:
                    long.append(f)
        out = []
        for fs in cut:
            ids, decoded = zip(*[known[f] for f in fs]) if fs else ((), ())
            out.append((b"".join(ids), b"".join(decoded)[1:]))
        if len(known) > CACHED_FRAGMENTS:
            known.clear()
        for f in long:
            known.pop(f, None)
        return out


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded text for every row."""
    def rows(doc_ids, coded):
        ids = [np.frombuffer(i, dtype="<u4").astype(np.int32) for i, _ in coded]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return [doc_ids, pa.array([len(i) for i in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([d.decode() for _, d in coded], pa.string())]

    return _mapped(docs, path, rows, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; ids and decoded texts stay in the task."""
    def rows(doc_ids, coded):
        return [doc_ids, pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in coded], pa.string())]

    return _mapped(docs, path, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str | None, rows, schema: str) -> DataFrame:
    where = path or public_tokenizers.path(VOCABULARY)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        codec = Codec(where)
        for batch in batches:
            for part in slices(batch, 1024):
                yield pa.RecordBatch.from_arrays(rows(part.column("doc_id"), codec.encode(utf8(part.column("text")))), names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
