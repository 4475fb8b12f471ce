"""Topic tags by many rules: one automaton for all literal rules, patterns only where a rule is no literal."""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = {c: c + 32 for c in range(65, 91)}      # like the patterns' (?i): ASCII letters only
_SPECIAL = re.compile(r"(?<!\\)[.^$*+?{}\[\]|()]")
_WHOLE = re.compile(r"(?P<any>\(\?i\))?(?P<left>\\b)?(?:\((?:\?:)?(?P<group>[^()]*)\)|(?P<one>.*?))(?P<right>\\b)?", re.S)


@dataclass(frozen=True)
class Literal:
    text: str
    any_case: bool
    left: bool       # a word boundary must stand before it
    right: bool


def literals(pattern: str) -> list[Literal] | None:
    """The literal texts a pattern stands for: ``(?i)``, word boundaries and one group of alternatives are understood. None for any other pattern."""
    found = _WHOLE.fullmatch(pattern)
    if not found:
        return None
    texts = found["group"].split("|") if found["group"] is not None else [found["one"]]
    out = []
    for text in texts:
        if not text or _SPECIAL.search(text) or re.search(r"\\[A-Za-z0-9]", text) or text.endswith("\\") and not text.endswith("\\\\"):
            return None
        out.append(Literal(re.sub(r"\\(.)", r"\1", text), found["any"] is not None, found["left"] is not None, found["right"] is not None))
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _boundary(text: str, at: int) -> bool:
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


class Automaton:
    """All literals of the rules; one pass over a text finds the rules that occur in it, whatever their number."""

    def __init__(self, rules: Sequence[tuple[int, Literal]]) -> None:
        self.words = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, Literal]]] = {}
        for number, literal in rules:
            by_text.setdefault(literal.text.translate(_LOWER), []).append((number, literal))
        for text, owners in by_text.items():
            self.words.add_word(text, (len(text), owners))
        self.words.make_automaton()

    def hits(self, text: str) -> set[int]:
        found: set[int] = set()
        if not len(self.words):
            return found
        for end, (size, owners) in self.words.iter(text.translate(_LOWER)):
            start = end + 1 - size
            for number, literal in owners:
                if number not in found and (literal.any_case or text[start:end + 1] == literal.text) and (
                        not literal.left or _boundary(text, start)) and (not literal.right or _boundary(text, end + 1)):
                    found.add(number)
        return found


def tag_many(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Comma-joined names of all (name, pattern) rules that match, in rule order; null text has none.

    Literal rules (``literals``) go into one automaton per task, built from the rules that travel with the plan. Only other patterns
    are tried one by one. Around word boundaries, letters and digits of any script count as word characters.
    """
    names = [name for name, _ in rules]
    read = [literals(pattern) for _, pattern in rules]
    plain = [(i, literal) for i, found in enumerate(read) if found for literal in found]
    others = [(i, pattern) for i, (found, (_, pattern)) in enumerate(zip(read, rules)) if not found]

    @F.pandas_udf("string")
    def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = Automaton(plain)
        for texts, more in batches:
            yield pd.Series([",".join(names[i] for i in sorted(automaton.hits(t or "") | set(m))) for t, m in zip(texts, more)], dtype=object)

    hits = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(i)) for i, pattern in others])) if others else F.array().cast("array<int>")
    return joined(text, F.coalesce(hits, F.array().cast("array<int>")))


def tag_documents_by_rules(df: DataFrame, rules: Sequence[tuple[str, str]], text: str = "text", require_topic: bool = False) -> DataFrame:
    """``df`` with ``topics``, for rule lists of any length; see ``tag_many``."""
    tagged = df.withColumn("topics", tag_many(F.col(text), rules))
    return tagged.where("topics <> ''") if require_topic else tagged
