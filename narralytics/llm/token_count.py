"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

A text longer than ``CHUNK_CHARS`` is encoded in chunks that overlap. A splice is a position inside the overlap
that (1) both encodings have as a token boundary and (2) is proven stable: the character before is no blank,
the one at it is a blank, and no piece of the vocabulary holds a blank after another character, so no merge
crosses it. Everything before the splice is taken from the left chunk, everything after from the right one. When
an overlap holds no such position it is doubled, until it does or the right chunk ends with the text.

Defined results: null is the empty text, with no bytes and no tokens; repeated rows count alike; an empty
table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm.common import slices, strings

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK_CHARS = 32768
OVERLAP_CHARS = 512
BLANK = "▁"  # the library's sign for a blank


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def blanks_lead(path: str) -> bool:
    """True when no piece holds a blank after another character: then a word start is never merged over."""
    sp = processor(path)
    return all(BLANK not in sp.id_to_piece(i).lstrip(BLANK) for i in range(sp.get_piece_size()))


def _stable(text: str, at: int) -> bool:
    return text[at] == " " and text[at - 1] not in (" ", BLANK)


def _boundaries(sp, text: str, start: int, end: int) -> list[int]:
    """Token starts of text[start:end] as positions in ``text``; the blank a chunk starts with is the library's own."""
    skip = 1 if start else 0
    offsets = sp.encode(text[start + skip:end], return_type="offset_mapping")["offsets"]
    starts = [start + skip + b for b, _ in offsets]
    return [start, *starts[1:]] if starts else starts


def count_tokens(sp, text: str, proven: bool = True, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one text; equal to encoding it whole."""
    if len(text) <= chunk or not proven:
        return len(sp.encode(text))
    total, start = 0, 0
    end = min(len(text), chunk)
    left = _boundaries(sp, text, start, end)
    while end < len(text):
        width, splice = overlap, None
        while splice is None and width < end - start:
            # the right chunk has to start at a word start itself, so look for one inside the overlap
            begin = next((p for p in range(end - width, end) if p > start and _stable(text, p)), None)
            if begin is not None:
                stop = min(len(text), begin + chunk)
                right = _boundaries(sp, text, begin, stop)
                both = set(left) & set(right)
                splice = next((p for p in sorted(both) if _stable(text, p)), None)
            width *= 2
        if splice is None:  # no word start in the whole chunk: widen it to the right
            end = min(len(text), end + chunk)
            left = _boundaries(sp, text, start, end)
            continue
        total += sum(p < splice for p in left)
        left = [p for p in right if p >= splice]
        start, end = splice, stop
    return total + len(left)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one narrow pass."""
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        sp, proven = processor(path), blanks_lead(path)
        for batch in batches:
            for part in slices(batch, 256):
                texts = strings(part.column("text"))
                short = [i for i, t in enumerate(texts) if len(t) <= CHUNK_CHARS]
                tokens = dict(zip(short, map(len, sp.encode([texts[i] for i in short], num_threads=1) if short else [])))
                counts = [tokens[i] if i in tokens else count_tokens(sp, t, proven) for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
