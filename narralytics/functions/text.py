"""Text normalisation, tokenisation and prompt assembly as Column -> Column functions.

Everything here is built from JVM expressions, so a chain of these stays in one projection.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from narralytics.constants import DELETED_MARKERS

# Java's \s is ASCII only; the (?U) class still misses the four information separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
NON_WHITESPACE = r"(?U)[^\s\x1c-\x1f]+"
# runs that one space has to replace: single spaces, which are most of them, stay as they are
UNEVEN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """Null becomes empty, whitespace runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), UNEVEN, " "))


def collapse_without_urls(text: Column) -> Column:
    no_urls = F.regexp_replace(F.coalesce(text, F.lit("")), "http" + NON_WHITESPACE, " ")
    return collapse(no_urls)


def match_key(text: Column) -> Column:
    """Case-insensitive comparison key. ``lower`` keeps the sharp s, so it is folded by hand."""
    return F.lower(F.replace(collapse(text), F.lit("ß"), F.lit("ss")))


def key_digest(text: Column) -> Column:
    """Fixed-width stand-in for a match key, so grouping never shuffles whole texts."""
    return F.sha2(match_key(text), 256)


def sentences(text: Column) -> Column:
    return F.filter(F.split(collapse(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WHITESPACE), "")  # a blank text splits into empty words


def word_count(text: Column) -> Column:
    return F.size(words(text))


def truncate(text: Column, limit: int) -> Column:
    flat = collapse(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def cluster_text(name: Column, terms: Column, docs: Column, doc_limit: int = 600, max_docs: int = 3) -> Column:
    """One description per cluster: its name, its terms and a few shortened documents."""
    empty = F.array().cast("array<string>")
    shortened = F.transform(F.slice(F.coalesce(docs, empty), 1, max_docs), lambda d: truncate(d, doc_limit))
    return F.concat(
        F.lit("Cluster name: "), F.coalesce(name, F.lit("")),
        F.lit(". Top terms: "), F.array_join(F.coalesce(terms, empty), ", "),
        F.lit(". Representative documents: "), F.array_join(shortened, " "),
    )


def usable_comment(text: Column, limit: int | None = None) -> Column:
    """Trimmed comment, clipped to ``limit`` characters when given; null when blank or a deletion marker."""
    stripped = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    keep = (stripped != "") & ~stripped.isin(DELETED_MARKERS)
    return F.when(keep, stripped if limit is None else F.substring(stripped, 1, limit))


def clean_markup(text: Column) -> Column:
    """HTML entities, quote prefixes and bold marks of forum markup."""
    out = F.coalesce(text, F.lit(""))
    for entity, plain in (("&#x200B;", ""), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(out, r"(?m)^[ \t]*>+ ?", "")
    return F.replace(out, F.lit("**"), F.lit(""))


def safe_number(value: Column, on_bad: str = "null") -> Column:
    """Numeric parse that never fails: bad text is null, or zero with ``on_bad='zero'``."""
    parsed = value.try_cast("double")
    return F.coalesce(parsed, F.lit(0.0)) if on_bad == "zero" else parsed


def safe_int(value: Column, on_bad: str = "zero") -> Column:
    return safe_number(value, on_bad).cast("long")


def title_label(label: Column) -> Column:
    return F.initcap(F.trim(label))


def display_label(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("empty_prediction")).otherwise(label)


def chat_messages(system: Column, instruction: Column, source: Column) -> Column:
    user = F.concat(instruction, F.lit("\n"), source)
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{{ name }}`` slots of a fixed template. Each value is inserted once, never re-scanned."""
    pieces: list[Column] = []
    rest = template
    while "{{" in rest:
        head, _, tail = rest.partition("{{")
        slot, _, rest = tail.partition("}}")
        pieces += [F.lit(head), F.coalesce(values[slot.strip()].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def first_tokens(tokens: Column, limit: int) -> Column:
    return F.array_join(F.slice(tokens, 1, limit), " ")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Last occurrence of a pattern, null when there is none."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))


def tokens_13a(text: Column) -> Column:
    """Case-preserving tokens of the published mteval-v13a rules."""
    line = F.coalesce(text, F.lit(""))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "),
                     ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, spaced in (
        (r"([!-&(-+/:-@\[-`{-~])", " $1 "),  # spaces need no spacing out
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        line = F.regexp_replace(line, pattern, spaced)
    return words(line)


def tokens_alnum(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits (the ROUGE tokeniser, before stemming)."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.array_remove(F.split(spaced, " "), "")


def tokens_linguistic(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, the input of the verb tagger."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams; a short list has none (``sequence`` would count down)."""
    none = F.array().cast("array<string>")

    def grams(t: Column) -> Column:
        last = F.size(t) - F.lit(n - 1)
        # indexed access is constant time; slice() would copy the whole list at every position
        windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1),
                              lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(n)]))
        return F.when(last > 0, windows).otherwise(none)

    if n == 1:
        return tokens
    # binding the list as a lambda argument evaluates it once, not once per position
    return F.element_at(F.transform(F.array(tokens), grams), 1)


_FREE_START = re.compile(r"((?:\(\?[a-z]+\))?\[[^\[\]\\&]+\])\+(?![+?])")


def existence_pattern(pattern: str) -> str:
    """A pattern that matches somewhere exactly where the given one does: a leading ``[...]+`` needs one character only."""
    return _FREE_START.sub(r"\1", pattern, count=1) if _FREE_START.match(pattern) else pattern


def tag_topics(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Comma-joined names of all regex rules that match, in rule order; ``text`` is computed once for all rules."""
    def hits(t: Column) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(t.rlike(existence_pattern(pattern)), F.lit(name)) for name, pattern in rules])), ",")

    return F.element_at(F.transform(F.array(text), hits), 1)
