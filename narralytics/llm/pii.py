"""Personal data in texts: base patterns, and candidates judged by boosted trees. DataFrame functions only.

Four base patterns give spans that always stay. For recall, one looser generator per kind proposes further
spans (spelled-out addresses, other separators, missing plus signs, numbers that stand beside other numbers). Each candidate has format,
validity and context features, and boosted trees give it a score. Labels come from the whole table, by joins on digests of values: a candidate
that touches no base span is positive when its value, with the usual separators, is that of a valid base span elsewhere in the table; it is negative when its
value is found only in places that are invalid (checksum, range, form) or embedded in a word or digit run; others have no label.
The valid base spans, rewritten where they stand (spelled out, with other separators, without plus sign), are further positives. The trees are fitted on the
counts of feature vectors of two thirds of the texts, by hash of the text; the threshold of each kind is set on the held-out third, as the score from
which on down a further range of candidates would fall below ``PRECISION``. A kind without examples of both labels on both sides is fitted and
calibrated on all its examples. Candidates above the threshold are added when they touch no base span and no added candidate that starts before. Only the counted feature
vectors (a grid of at most ``GRID`` rows) reach the driver.

Positions are code points, ends exclusive. The patterns are written so that a run of like characters is read
once: possessive repeats, and starts only at the beginning of a run or where the last match ended. Work is linear in the text and in its matches: running
sums and maxima go over blocks of ``BLOCK`` matches first and then inside the block, and what touches what is read off one sorted list.

Defined results: null is the empty text, without spans; repeated rows are judged alike; an empty table gives an
empty result; further columns are ignored (or kept by ``redact``).
"""
from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.llm import trees
from narralytics.llm.common import text_or_empty
from narralytics.session import Scratch

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns, possessive where nothing follows that could need the characters back
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
             r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\x20?(?:\.|,|:|-|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20./_-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?:(?:\+|\b00)\x20?)?\(?[0-9]{1,4}+\)?(?:[\x20./()-]{1,2}[0-9]{2,4}+){2,4}(?![0-9])",
}
GUARD = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = r"(?i)\b(?:e-?mail|mail|contact|call|tel|phone|fax|mobile|card|visa|pay|account|ip|host|server|address|from)\b"
PRECISION = 0.9
SPAN = "array<struct<start:int,kind:int,finish:int>>"
FOUND = "array<struct<start:int,kind:int,finish:int,key:bigint>>"
PROPOSED = ("array<struct<start:int,kind:int,finish:int,digits:int,marks:int,plus:int,hint:int,before:int,after:int,"
            "form:int,valid:int,key:bigint>>")
FEATURES = ("kind", "digits", "marks", "plus", "hint", "before", "after", "form", "valid")
GRID = 2 * 2 * 4 * 5 * 3 * 2 * 2 * 3 * 3 * 5 * 2   # labels, sides and most feature vectors there can be: 86 400
BLOCK = 32          # matches per block of a running sum; a power of two
SPELLED = r"\(at\)|\[at\]|\(dot\)|\[dot\]|\[\.\]|\(\.\)"
# (pattern, replacement) pairs that rewrite a valid base span into forms which the base patterns do not match
REWRITES = {
    "email": [[("@", " [at] "), (r"\.", " [dot] ")], [("@", "(at)"), (r"\.", "(dot)")], [("@", " (at) ")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", "(.)")]],
    "card": [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", f"$1{mark}")] for mark in "./_"],
    "phone": [[(r"\+", "")], [(r"\+", "00")], [(r"\+", ""), (r"[\x20()-]+", ".")],
              [(r"^\+[0-9]{1,3}[\x20.-]+(?=\(?[0-9])|\+", "")]],
}
ROUNDS, DEPTH = 20, 3


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step, zero: int) -> Column:
    """array<int>: for every value the aggregate of those before it, by block totals first."""
    shift = BLOCK.bit_length() - 1

    def blocks(x: Column) -> Column:
        count = F.shiftright(F.size(x.v) - 1, shift) + 1
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice(x.v, b * BLOCK + 1, BLOCK), F.lit(zero), step))
        return F.aggregate(sums, F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda acc, n: F.struct(step(acc.at, n).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    def places(x: Column) -> Column:
        inside = lambda i: F.aggregate(F.slice(x.v, i - i.bitwiseAND(BLOCK - 1) + 1, i.bitwiseAND(BLOCK - 1)), F.lit(zero), step)
        return F.transform(x.v, lambda v, i: step(F.get(x.before, F.shiftright(i, shift)), inside(i)))

    made = _let(F.struct(values.alias("v")), lambda x: F.when(F.size(x.v) > 0, _let(F.struct(x.v.alias("v"), blocks(x).alias("before")), places)))
    return F.coalesce(made, F.array().cast("array<int>"))


def plus(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _side(char: Column) -> Column:
    """Kind of a neighbouring character: 0 none or blank, 1 letter or digit, 2 other."""
    return F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike(r"^[\p{L}0-9]"), 1).otherwise(2)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, finish, value, before, after>> of the leftmost non-overlapping matches."""
    def found(x: Column) -> Column:
        ends = running(F.transform(x["values"], lambda v, i: F.length(F.get(x.gaps, i)) + F.length(v)), plus, 0)
        return _let(F.struct(x.gaps.alias("gaps"), x["values"].alias("values"), ends.alias("at")), lambda y: F.transform(y["values"], lambda v, i: F.struct(
            (F.get(y.at, i) + F.length(F.get(y.gaps, i))).alias("start"), (F.get(y.at, i) + F.length(F.get(y.gaps, i)) + F.length(v)).alias("finish"),
            v.alias("value"), F.right(F.get(y.gaps, i), F.lit(24)).alias("before"), F.substring(F.get(y.gaps, i + 1), 1, 1).alias("after"))))

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, digits.substr(i, F.lit(1)).cast("int")).otherwise(
        F.get(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), digits.substr(i, F.lit(1)).cast("int"))))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(value)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _valid_loose(kind: str, value: Column) -> Column:
    """Whether a candidate is a span of its kind once its separators are read as the usual ones."""
    if kind == "email":   # a spelled-out dot may stand between blanks, a plain one may not
        return value.rlike(r"(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z]{2,}$") & ~value.rlike(r"\x20\.|\.\x20")
    if kind == "ip":
        return _valid(kind, F.regexp_replace(value, "[^0-9]+", "."))
    return _valid(kind, value)


def _form(value: Column) -> Column:
    """Separators: 0 none, blank or hyphen, 1 spelled out or bracketed, 2 comma, colon, slash or low line, 3 parenthesis, 4 dot."""
    return (F.when(value.rlike(SPELLED), 1).when(value.rlike("[,:/_]"), 2).when(value.rlike("[()]"), 3)
            .when(value.contains("."), 4).otherwise(0))


def _joined(arrays: list[Column]) -> Column:
    return F.array_sort(F.concat(*arrays))


def _base_matches(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m.value))


def _key(kind: str, value: Column) -> Column:
    """Digest of the value with the usual separators; of a telephone number its last nine digits."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(value, r"\x20?(?:\(at\)|\[at\]|@)\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?", ".")
        return F.xxhash64(F.lit(kind), F.lower(plain))
    if kind == "ip":
        return F.xxhash64(F.lit(kind), F.regexp_replace(F.regexp_replace(value, "[^0-9]+", "."), r"(^|\.)0+(?=[0-9])", "$1"))
    digits = _digits(value)
    return F.xxhash64(F.lit(kind), F.right(digits, F.lit(9)) if kind == "phone" else digits)


def base_found(text: Column) -> Column:
    """array<struct<start, kind, finish, key>> of the base patterns, by start, then kind as listed."""
    def of(k: int, kind: str) -> Column:
        good = _base_matches(text, kind)
        spans = F.transform(good, lambda m: F.struct(m.start.alias("start"), F.lit(k).alias("kind"), m.finish.alias("finish"), _key(kind, m.value).alias("key")))
        return F.when(text.rlike(GUARD[kind]), spans).otherwise(F.array().cast(FOUND))

    return _joined([of(k, kind) for k, kind in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, finish>> of the base patterns, by start, then kind as listed."""
    def of(k: int, kind: str) -> Column:
        good = _base_matches(text, kind)
        spans = F.transform(good, lambda m: F.struct(m.start.alias("start"), F.lit(k).alias("kind"), m.finish.alias("finish")))
        return F.when(text.rlike(GUARD[kind]), spans).otherwise(F.array().cast(SPAN))

    return _joined([of(k, kind) for k, kind in enumerate(KINDS)])


def _features(kind: str, value: Column, before: Column, after: Column, valid: Column) -> list[Column]:
    """The features after the kind, in the order of ``FEATURES``."""
    digits, marks = F.length(_digits(value)), F.length(F.regexp_replace(value, r"[A-Za-z0-9]", ""))
    return [F.when(digits < 9, 0).when(digits < 12, 1).when(digits < 16, 2).when(digits == 16, 3).otherwise(4).alias("digits"),
            F.when(marks == 0, 0).when(marks < 3, 1).otherwise(2).alias("marks"),
            value.startswith("+").cast("int").alias("plus"), before.rlike(CONTEXT).cast("int").alias("hint"),
            _side(F.right(before, F.lit(1))).alias("before"), _side(after).alias("after"), _form(value).alias("form"), valid.cast("int").alias("valid")]


def candidates(text: Column) -> Column:
    """Proposed spans with their features and keys, by start, then kind."""
    def of(k: int, kind: str) -> Column:
        made = F.transform(_matches(text, LOOSE[kind]), lambda m: F.struct(
            m.start.alias("start"), F.lit(k).alias("kind"), m.finish.alias("finish"),
            *_features(kind, m.value, m.before, m.after, _valid_loose(kind, m.value)), _key(kind, m.value).alias("key")))
        return F.when(text.rlike(GUARD[kind]), made).otherwise(F.array().cast(PROPOSED))

    return _joined([of(k, kind) for k, kind in enumerate(KINDS)])


def free_candidates(base: Column, proposed: Column) -> Column:
    """The candidates that touch no base span, in their order.

    In the list of both, sorted by start, a candidate touches a base span when one before it ends behind its start, or the next one begins before its end.
    """
    far = (1 << 31) - 1

    def flagged(x: Column) -> Column:
        ends = running(F.transform(x.all, lambda e: F.when(e.at < 0, e.finish).otherwise(0)), most, 0)
        nexts = F.reverse(running(F.transform(F.reverse(x.all), lambda e: F.when(e.at < 0, e.start).otherwise(F.lit(far))), least, far))
        return _let(F.struct(x.all.alias("all"), x.proposed.alias("proposed"), ends.alias("ends"), nexts.alias("nexts")), lambda y: F.transform(
            F.filter(y.all, lambda e, i: (e.at >= 0) & (F.get(y.ends, i) <= e.start) & (F.get(y.nexts, i) >= e.finish)), lambda e: F.get(y.proposed, e.at)))

    def merged(x: Column) -> Column:
        of_base = F.transform(x.base, lambda b: F.struct(b.start.alias("start"), F.lit(-1).alias("at"), b.finish.alias("finish")))
        of_proposed = F.transform(x.proposed, lambda c, i: F.struct(c.start.alias("start"), i.alias("at"), c.finish.alias("finish")))
        return F.when((F.size(x.base) == 0) | (F.size(x.proposed) == 0), x.proposed).otherwise(
            _let(F.struct(F.array_sort(F.concat(of_base, of_proposed)).alias("all"), x.proposed.alias("proposed")), flagged))

    return _let(F.struct(base.alias("base"), proposed.alias("proposed")), merged)


def rewritten(text: Column) -> Column:
    """Feature vectors of the valid base spans in the forms of ``REWRITES``."""
    def of(k: int, kind: str) -> Column:
        def forms(m: Column) -> Column:
            values = []
            for pairs in REWRITES[kind]:
                values.append(m.value)
                for pattern, new in pairs:
                    values[-1] = F.regexp_replace(values[-1], pattern, new)
            good = F.filter(F.array(*values), lambda v: _valid_loose(kind, v))
            return F.transform(good, lambda v: F.struct(F.lit(k).alias("kind"), *_features(kind, v, m.before, m.after, F.lit(True))))

        made = F.flatten(F.transform(_base_matches(text, kind), forms))
        return F.when(text.rlike(GUARD[kind]), made).otherwise(F.array())

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def counted(docs: DataFrame) -> DataFrame:
    """Counts of every distinct (feature vector, held, y) over all labelled examples of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    text = docs.select(text_or_empty().cast("string").alias("t")).where(F.col("t").rlike(r"@|\(at\)|\[at\]|[0-9]"))
    scanned = text.select((F.pmod(F.xxhash64("t"), F.lit(3)) == 0).alias("held"), base_found(F.col("t")).alias("base"), candidates(F.col("t")).alias("proposed"),
                          rewritten(F.col("t")).alias("made"))
    one = lambda c: F.explode(c).alias("c")
    parts = scanned.select("held", F.col("base.key").alias("valid_keys"), "made", free_candidates(F.col("base"), F.col("proposed")).alias("free"))
    # one scan: every example is counted by its key, valid values as rows of their own
    key = lambda c, known, made: F.struct(*[(c[f] if c is not None else F.lit(None).cast("int")).alias(f) for f in FEATURES], known.alias("key"), F.lit(made).alias("role"))
    rows = F.concat(F.transform("free", lambda c: key(c, c.key, "free")), F.transform("made", lambda c: key(c, F.lit(None).cast("bigint"), "made")),
                    F.transform(F.array_distinct("valid_keys"), lambda k: key(None, k, "valid")))
    seen = scratch.write(parts.select("held", one(rows)).groupBy("held", "c.role", "c.key", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
                         .agg(F.count(F.lit(1)).alias("n")), "pii-examples")
    free = seen.where("role = 'free'")
    embedded = (F.col("kind") != KINDS.index("email")) & ((F.col("before") == 1) | (F.col("after") == 1))
    numbers = (F.col("kind") == KINDS.index("ip")) & (F.col("form") != 1)       # plain lists of four numbers
    places = free.groupBy("key").agg(F.min((F.col("valid") == 0) | embedded | numbers).alias("bad"))
    valid = seen.where("role = 'valid'").select("key").distinct().withColumn("known", F.lit(True))
    labelled = free.join(places, "key").join(valid, "key", "left").withColumn("y", F.when(F.col("known"), 1).when(F.col("bad"), 0)).where("y IS NOT NULL")
    made = seen.where("role = 'made'").withColumn("y", F.lit(1))
    both = labelled.select(*FEATURES, "held", "y", "n").unionByName(made.select(*FEATURES, "held", "y", "n"))
    result = scratch.write(both.groupBy(*FEATURES, "held", "y").agg(F.sum("n").alias("n")), "pii-counts")
    scratch.drop("pii-examples")
    return result


def fit_counts(rows: list[tuple]) -> tuple[tuple[float, list], dict[int, float], dict[str, dict]]:
    """(trees, threshold per kind, held-out figures per kind) from the rows of ``counted``."""
    if not rows:
        return (0.0, []), {}, {}
    data = np.array(sorted(tuple(map(int, r)) for r in rows), dtype=float)
    x, held, y, n = data[:, :len(FEATURES)], data[:, -3] > 0, data[:, -2], data[:, -1]
    train, test = ~held, held.copy()
    for kind in range(len(KINDS)):
        of = x[:, 0] == kind
        if not all((y[of & side] == label).any() for side in (held, ~held) for label in (0, 1)):    # too few to hold some out
            train[of] = test[of] = True
    model = trees.fit(x[train], y[train], n[train], ROUNDS, DEPTH)
    score = trees.predict(model, x)
    limits, figures = {}, {}
    for kind, name in enumerate(KINDS):
        of = (x[:, 0] == kind) & test
        levels = np.unique(score[of])
        worth = [(n * (y - PRECISION))[of & (score >= level - 1e-9)].sum() for level in levels]
        if len(levels) and max(worth) > 0:   # every range of levels above the threshold keeps the precision down to it
            limits[kind] = float(levels[int(np.argmax(worth))] - 1e-9)
        taken = of & (score >= limits.get(kind, np.inf))
        figures[name] = {"examples": int(n[of].sum()), "positive": int((n * y)[of].sum()),
                         "precision": float((n * y)[taken].sum() / max(1, n[taken].sum())), "recall": float((n * y)[taken].sum() / max(1, (n * y)[of].sum()))}
    return model, limits, figures


def fit(docs: DataFrame) -> tuple[tuple[float, list], dict[int, float]]:
    """(trees, threshold per kind) from all labelled examples of ``docs``; the counted grid is bounded by ``GRID`` rows."""
    return fit_counts([tuple(r) for r in counted(docs).collect()])[:2]


def added_spans(base: Column, proposed: Column, model, limits: dict[int, float]) -> Column:
    """Candidates that the trees accept, touching no base span and no accepted one that starts before."""
    if not limits:
        return F.array().cast(SPAN)
    wanted = F.create_map(*itertools.chain(*((F.lit(k), F.lit(v)) for k, v in limits.items())))
    accepted = F.filter(proposed, lambda c: F.coalesce(
        trees.expression(model, lambda f: c[FEATURES[f]]) >= F.try_element_at(wanted, c.kind), F.lit(False)))

    def apart(x: Column) -> Column:
        ends = running(F.transform(x.c, lambda c: c.finish), most, 0)
        return _let(F.struct(x.c.alias("c"), ends.alias("ends")), lambda y: F.transform(
            F.filter(y.c, lambda c, i: F.get(y.ends, i) <= c.start),
            lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.finish.alias("finish"))))

    return _let(F.struct(free_candidates(base, accepted).alias("c")), apart)


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.finish)), ",")


def detect(docs: DataFrame, model=None) -> DataFrame:
    """All columns of ``docs`` with pii_base and pii_added, arrays of (start, kind, finish)."""
    fitted, limits = model or fit(docs)
    text = text_or_empty().cast("string")
    some = docs.withColumn("pii_base", base_spans(text))
    if not limits:
        return some.withColumn("pii_added", F.array().cast(SPAN))
    return some.withColumn("pii_proposed", candidates(text)).withColumn(
        "pii_added", added_spans(F.col("pii_base"), F.col("pii_proposed"), fitted, limits)).drop("pii_proposed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    def count(k: int) -> Column:
        return F.size(F.filter("pii_base", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("pii_base")), 256).alias("base_sha256"),
                        spans_text(_joined([F.col("pii_base"), F.col("pii_added")])).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by the name of its kind in brackets; a null text stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = detect(docs)
    text = F.col("text").cast("string")

    def pieces(x: Column) -> Column:
        """What stands between the spans, and their names; a span that begins inside another one has none."""
        between = lambda a, b: F.array_join(F.slice(x.chars, a + 1, b - a), "")
        named = F.transform(x.spans, lambda s, i: F.when(s.start >= F.get(x.ends, i), F.concat(
            between(F.get(x.ends, i), s.start), F.get(names, s.kind))).otherwise(""))
        return F.array_join(F.concat(named, F.array(between(F.array_max(x.spans.finish), F.size(x.chars)))), "")

    spans = _joined([F.col("pii_base"), F.col("pii_added")])
    clean = F.when((F.size("pii_base") == 0) & (F.size("pii_added") == 0), text).otherwise(_let(F.struct(spans.alias("spans")), lambda x: _let(F.struct(
        F.split(text, "").alias("chars"), x.spans.alias("spans"), running(x.spans.finish, most, 0).alias("ends")), pieces)))
    return found.withColumn("text", F.when(text.isNotNull(), clean)).select(*[F.col(f"`{c}`") for c in docs.columns])
