"""Tokens of whole texts inside Arrow tasks: texts are cut at white space and every distinct word of some rows is tokenised once.

The tokens are those of ``text.tokens_13a`` and ``text.tokens_alnum``: no rule of the two looks past the white space beside a
word, but for the marks of ``JOINED_13A``, which are taken out of the whole text first.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from narralytics.functions import porter
from narralytics.functions.plugins import stemmed, strings

OTHER_SPACE = r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JOINED_13A = ("<skipped>", "-\n")
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPACED_13A = tuple((re.compile(pattern), spaced) for pattern, spaced in (
    (r"([!-&(-+/:-@\[-`{-~])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")))
_RULES_13A = r"&|[0-9][.,\-]|[.,][0-9]"
_APART_13A = re.compile(r"\n|[!-&(-,./:-@\[-`{-~]|[^\n!-&(-,./:-@\[-`{-~]+")   # what is left of the rules in words without the above
_ALNUM = re.compile(r"\n|[a-z0-9]+")

Cut = Callable[[pa.Array], pa.ListArray]


class Words:
    """The distinct words of some texts, and for each word in order its number and the text it stands in."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        other = pc.any(pc.match_substring_regex(texts, OTHER_SPACE)).as_py()
        lists = pc.utf8_split_whitespace(texts) if other else pc.split_pattern(texts, " ")     # empty words have no tokens
        coded = lists.flatten().dictionary_encode()
        self.distinct, self.at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())


def _found(words: pa.Array, pattern: re.Pattern, lower: bool = False) -> pa.ListArray:
    """All matches in every word; the words are searched as the lines of one text."""
    if not len(words):
        return pa.array([], pa.list_(pa.string()))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
    found = pa.array(pattern.findall(lines.lower() if lower else lines), pa.string())
    line_end = pc.equal(found, "\n")
    ends = np.flatnonzero(line_end.to_numpy(zero_copy_only=False))
    tokens = found.filter(pc.invert(line_end))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends - np.arange(len(ends)), [len(tokens)]]).astype(np.int32)), tokens)


def word_13a(word: str) -> list[str]:
    for old, new in _ENTITIES:
        word = word.replace(old, new)
    line = f" {word} "
    for pattern, spaced in _SPACED_13A:
        line = pattern.sub(spaced, line)
    return line.split()


def cut_13a(words: pa.Array) -> pa.ListArray:
    ruled = pc.match_substring_regex(words, _RULES_13A)
    lists = pa.concat_arrays([_found(words.filter(pc.invert(ruled)), _APART_13A),
                              pa.array([word_13a(w) for w in strings(words.filter(ruled))], pa.list_(pa.string()))])
    place = np.argsort(ruled.to_numpy(zero_copy_only=False), kind="stable")     # the words as they stand in ``lists``
    return lists.take(pa.array(np.argsort(place, kind="stable")))


def cut_alnum(words: pa.Array) -> pa.ListArray:
    return _found(words, _ALNUM, lower=True)


def make_13a() -> Cut:
    return cut_13a


def make_alnum() -> Cut:
    return cut_alnum


known_stem = lru_cache(maxsize=200_000)(porter.stem)    # one table per process, so tasks of a worker share it


def make_stems() -> Cut:
    return lambda words: stemmed(cut_alnum(words), known_stem, rows=50_000)


def numbered_tokens(texts: pa.Array, cut: Cut, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The numbered tokens of all texts, one text after another, and the text of each. ``words`` are those of the texts, if known."""
    return named_tokens(texts, cut, words)[:2]


def named_tokens(texts: pa.Array, cut: Cut, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``numbered_tokens`` and the token of each number."""
    for mark in JOINED_13A if cut is cut_13a else ():
        if pc.any(pc.match_substring(texts, mark)).as_py():
            texts, words = pc.replace_substring(texts, mark, ""), None
    words = words or Words(texts)
    lists = cut(words.distinct)
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    flat = coded.indices.to_numpy().astype(np.int64)
    size = sizes[words.at]
    first = (np.cumsum(sizes) - sizes)[words.at] - (np.cumsum(size) - size)
    return flat[np.repeat(first, size) + np.arange(int(size.sum()))], np.repeat(words.of, size), coded.dictionary


def sentence_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of ``text.sentences`` as runs of words: the number of every word that is not empty, the sentence it stands in
    (0, 1, ... over all texts), and the text of every sentence."""
    ends = pc.or_(pc.or_(pc.ends_with(words.distinct, "."), pc.ends_with(words.distinct, "!")), pc.ends_with(words.distinct, "?"))
    kept = pc.not_equal(words.distinct, "").to_numpy(zero_copy_only=False)[words.at]
    at, of = words.at[kept], words.of[kept]
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = ends.to_numpy(zero_copy_only=False)[at[:-1]] | (of[1:] != of[:-1])
    return at, np.cumsum(begins) - 1, of[begins]
