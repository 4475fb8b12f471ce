"""Text functions applied to whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from narralytics.catalog.registry import query
from narralytics.catalog.views import documents, norm_sql, table
from narralytics.constants import COARSE_LABEL, MAX_COMMENT_CHARS
from narralytics.functions import text as T
from narralytics.functions.labels import remap_label

KEY_SQL = f"lower(replace({norm_sql('text')}, 'ß', 'ss'))"
WORDS_SQL = f"CASE WHEN {norm_sql('text')} = '' THEN [] ELSE string_split({norm_sql('text')}, ' ') END"
SENTENCES_SQL = (f"list_filter(string_split(regexp_replace({norm_sql('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
                 "lambda s: s <> '')")
TOKENS_13A_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' ||
    replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '),
    '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
    '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'),
    '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"""


def tokens_13a_sql(column: str) -> str:
    line = f"trim(regexp_replace({TOKENS_13A_SQL.format(column)}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {line} = '' THEN [] ELSE string_split({line}, ' ') END"


def tokens_alnum_sql(column: str) -> str:
    line = f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {line} = '' THEN [] ELSE string_split({line}, ' ') END"


def _docs(spark, sf):
    return documents(spark, sf).select("doc_id", "text")


@query("text_collapse_whitespace", "T1", f"SELECT doc_id, {norm_sql('text')} AS out FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse(F.col("text")).alias("out"))


@query("text_strip_urls", "T2", f"""SELECT page_id, {norm_sql("regexp_replace(html, 'http[^ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r" + chr(92) + "f" + chr(92) + "v]+', ' ', 'g')")} AS out FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.collapse_without_urls(F.col("html")).alias("out"))


@query("text_match_key", "T3", f"SELECT doc_id, {KEY_SQL} AS match_key, sha256({KEY_SQL}) AS digest FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.match_key(F.col("text")).alias("match_key"),
                                   T.key_digest(F.col("text")).alias("digest"))


@query("text_sentence_split", "T4", f"""
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentences[pos] AS sentence
    FROM (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS pos
          FROM (SELECT doc_id, {SENTENCES_SQL} AS sentences FROM documents))""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence")).select(
        "doc_id", (F.col("p") + 1).alias("pos"), "sentence")


@query("text_word_count", "T5", f"SELECT doc_id, CAST(len({WORDS_SQL}) AS INTEGER) AS words FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("text_truncate", "T6", f"""
    SELECT doc_id, CASE WHEN length({norm_sql('text')}) <= 600 THEN {norm_sql('text')}
                        ELSE rtrim(substr({norm_sql('text')}, 1, 597)) || '...' END AS out FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 600).alias("out"))


@query("text_usable_comment", "T8", """
    SELECT doc_id, out FROM (SELECT doc_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 5000) AS out FROM documents)
    WHERE out <> '' AND out NOT IN ('[deleted]', '[removed]')""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.usable_comment(F.col("text"), MAX_COMMENT_CHARS).alias("out")).where("out is not null")


@query("text_clean_markup", "T9", r"""
    SELECT page_id, replace(regexp_replace(replace(replace(replace(replace(html, '&#x200B;', ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
        '(?m)^[ \t]*>+ ?', '', 'g'), '**', '') AS out FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_markup(F.col("html")).alias("out"))


FINE = list(COARSE_LABEL)
FINE_SQL = "[" + ",".join(f"'{x}'" for x in FINE) + "]"
MAP_SQL = "MAP {" + ",".join(f"'{fine}': '{coarse}'" for fine, coarse in COARSE_LABEL.items()) + "}"


@query("label_remap", "T10", f"""
    SELECT event_id, {MAP_SQL}[fine] AS coarse FROM (
        SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE
               {FINE_SQL}[CAST((user_id * 31 + event_id) % {len(FINE)} + 1 AS INTEGER)] END AS fine FROM events)""")
def _(spark, sf):
    position = (F.pmod(F.col("user_id") * 31 + F.col("event_id"), F.lit(len(FINE))) + 1).cast("int")
    fine = F.concat(F.lit(" "), F.upper(F.element_at(F.array(*[F.lit(x) for x in FINE]), position)), F.lit(" "))
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("")).otherwise(fine).alias("fine"))
    return events.select("event_id", remap_label(F.col("fine")).alias("coarse"))


@query("text_safe_number", "T11", """
    SELECT doc_id, round(TRY_CAST(substr(source, 4) AS DOUBLE), 6) AS parsed,
           CAST(coalesce(TRY_CAST(lang AS DOUBLE), 0) AS BIGINT) AS zeroed FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.safe_number(F.substring("source", 4, 100)).alias("parsed"), T.safe_int(F.col("lang")).alias("zeroed"))


@query("text_title_label", "T12", """
    SELECT event_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS out FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", T.title_label(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("out"))


@query("text_display_label", "T13", """
    SELECT d.doc_id, CASE WHEN toxic = 1 OR toxic IS NULL THEN 'empty_prediction' ELSE 'labelled' END AS out
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = F.when(F.col("toxic") == 1, F.lit("")).when(F.col("toxic") == 0, F.lit("labelled"))
    return joined.select("doc_id", T.display_label(raw).alias("out"))


TEMPLATE = "Comment:\n{{ source_text }}\n\nLanguage: {{ lang }}\nScore it."


@query("text_prompt_assembly", "T14", """
    SELECT doc_id, 'Comment:' || chr(10) || text || chr(10) || chr(10) || 'Language: ' || lang || chr(10) || 'Score it.' AS prompt,
           'system|Answer briefly.|user|Extract the narrative.' || chr(10) || text AS messages FROM documents""")
def _(spark, sf):
    chat = T.chat_messages(F.lit("Answer briefly."), F.lit("Extract the narrative."), F.col("text"))
    flat = F.array_join(F.transform(chat, lambda m: F.concat_ws("|", m["role"], m["content"])), "|")
    return table(spark, sf, "documents").select(
        "doc_id", T.render(TEMPLATE, {"source_text": F.col("text"), "lang": F.col("lang")}).alias("prompt"),
        flat.alias("messages"))


@query("text_first_tokens", "T15", f"""
    SELECT doc_id, array_to_string(list_slice(t, 1, 64), ' ') AS out, len(t) > 64 AS truncated
    FROM (SELECT doc_id, {tokens_13a_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    tokens = T.tokens_13a(F.col("text"))
    return _docs(spark, sf).select("doc_id", tokens.alias("t")).select(
        "doc_id", T.first_tokens(F.col("t"), 64).alias("out"), (F.size("t") > 64).alias("truncated"))


@query("text_last_number", "T16", r"""SELECT doc_id, list_last(regexp_extract_all(text, '([0-9]+)', 1)) AS last_number FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.last_match(F.col("text"), "([0-9]+)").alias("last_number"))


@query("text_last_progress", "T16", r"""
    SELECT user_id, CAST(list_last(regexp_extract_all(log, '(\d+)/3915', 1)) AS BIGINT) AS progress FROM (
        SELECT user_id, string_agg(CASE WHEN event_type = 'error' THEN 'failed' ELSE event_id || '/3915' END, chr(10) ORDER BY event_id) AS log
        FROM events GROUP BY user_id)""")
def _(spark, sf):
    line = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("/3915")))
    logs = table(spark, sf, "events").select("user_id", "event_id", line.alias("line"))
    # the last progress line of a log is the last matching line in order: no log text is assembled
    hit = F.regexp_extract("line", r"(\d+)/3915", 1)
    progress = F.max_by(hit, F.when(hit != "", F.col("event_id")))
    return logs.groupBy("user_id").agg(progress.cast("long").alias("progress"))


@query("text_tokens_13a", "T20", f"""
    SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT doc_id, {tokens_13a_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.tokens_13a(F.col("text")).alias("t")).select(
        "doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n"))


@query("text_tokens_alnum", "T21", f"""
    SELECT doc_id, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens_alnum_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(T.tokens_alnum(F.col("text")), " ").alias("tokens"))


@query("text_stemmed_tokens", "T21")
def _(spark, sf):
    from narralytics.functions.plugins import stem_tokens
    return _docs(spark, sf).select("doc_id", F.array_join(stem_tokens(T.tokens_alnum(F.col("text"))), " ").alias("stems"))


@query("text_trigrams", "T22", f"""
    SELECT gram, count(*) AS n FROM (
        SELECT t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS gram FROM (
            SELECT t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {WORDS_SQL} AS t FROM documents) WHERE len(t) >= 3))
    GROUP BY gram""")
def _(spark, sf):
    grams = _docs(spark, sf).select(F.explode(T.ngrams(T.words(F.col("text")), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))
