"""English suffix stripping after Porter (1980), written as rule tables."""
from __future__ import annotations

from collections.abc import Iterable

VOWELS = "aeiou"

# fixed values: published suffix rules, tried longest first; the measure bound follows each table
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
CHAINED_SUFFIXES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
FINAL_SUFFIXES = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


class _Letters(dict):
    """Code point -> v or c; any character that is no vowel counts as a consonant."""

    def __missing__(self, point: int) -> str:
        self[point] = "v" if chr(point) in VOWELS else "c"
        return self[point]


_LETTERS = _Letters()


def _by_length(suffixes: Iterable[str]) -> list[tuple[int, set[str]]]:
    """(length, suffixes of that length), longest first."""
    suffixes = list(suffixes)
    return [(n, {s for s in suffixes if len(s) == n}) for n in sorted({len(s) for s in suffixes}, reverse=True)]


_DOUBLE, _CHAINED, _FINAL = (_by_length(t) for t in (DOUBLE_SUFFIXES, CHAINED_SUFFIXES, FINAL_SUFFIXES))


def _shape(word: str) -> str:
    """Consonant/vowel pattern of a word; y is a vowel after a consonant."""
    pattern = word.translate(_LETTERS)
    start = word.find("y", 1)
    while start > 0:        # from left to right: what y is hangs on what stands before it
        if pattern[start - 1] == "c":
            pattern = f"{pattern[:start]}v{pattern[start + 1:]}"
        start = word.find("y", start + 1)
    return pattern


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _closes_short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _suffix(word: str, lengths: list[tuple[int, set[str]]]) -> str:
    """The longest listed suffix of a word, or nothing."""
    for n, suffixes in lengths:
        if word[-n:] in suffixes:
            return word[-n:]
    return ""


def _swap(word: str, table: dict[str, str], lengths: list[tuple[int, set[str]]], bound: int) -> str:
    suffix = _suffix(word, lengths)
    if not suffix:
        return word
    stem = word[:-len(suffix)]
    return stem + table[suffix] if _measure(stem) > bound else word


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if not word.endswith(suffix):
            continue
        stem = word[: len(word) - len(suffix)]
        shape = _shape(stem)
        if "v" in shape:
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if shape[-2:] == "cc" and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if shape.count("vc") == 1 and _closes_short(stem) else stem
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; three letters or fewer stay as they are."""
    if len(word) <= 3:
        return word
    word = _tense(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, DOUBLE_SUFFIXES, _DOUBLE, 0), CHAINED_SUFFIXES, _CHAINED, 0)
    suffix = _suffix(word, _FINAL)
    if suffix:
        base = word[:-len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        measure = _measure(base)
        if measure > 1 or (measure == 1 and not _closes_short(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
