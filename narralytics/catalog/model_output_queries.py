"""Parsing, judging, generation and batching over text that Spark derives from documents."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.registry import query
from narralytics.catalog.stats_queries import rounded
from narralytics.constants import EMOTION_LABELS
from narralytics.functions.text import collapse, tokens_13a
from narralytics.operators import align as A
from narralytics.operators import generation as G
from narralytics.operators import judge as J
from narralytics.operators import label_metrics as L
from narralytics.operators import parsing as P
from narralytics.operators import runs as R
from narralytics.operators.score_cache import ScoreCache, score_with_stored_cache
from narralytics.session import scratch_path

ESCAPED_SQL = f"""replace(replace({V.norm_sql('text')}, '\\', '\\\\'), '"', '\\"')"""
VALID_SQL = """'{"predicted_narrative":"' || t || '","predicted_emotion_label":"' || l || '"}'"""
RAW_SQL = f"""raw AS (SELECT doc_id AS sample_id, n_chars, CASE doc_id % 8
        WHEN 1 THEN '{{"predicted_narrative":"' || t || '","predicted_emotion_label":"' || l || '"'
        WHEN 2 THEN '{{"predicted_narrative":"' || t || '","predicted_emotion_label":"' || l || '","reason":"x"}}'
        WHEN 3 THEN '{{"predicted_narrative":"' || t || '","predicted_emotion_label":"Annoyance"}}'
        WHEN 4 THEN '{{"predicted_narrative":"  ","predicted_emotion_label":"' || l || '"}}'
        WHEN 5 THEN '{{"predicted_narrative":42,"predicted_emotion_label":"' || l || '"}}'
        WHEN 6 THEN 'Sure: ' || {VALID_SQL} || ' Done.' WHEN 7 THEN '[' || {VALID_SQL} || ']' ELSE {VALID_SQL} END AS raw_generation
    FROM (SELECT doc_id, n_chars, {ESCAPED_SQL} AS t, {V.label_sql('doc_id')} AS l FROM documents))"""
# text that is no JSON is replaced before the other tests look into it
STRICT_SQL = RAW_SQL + f""", safe AS (SELECT sample_id, raw_generation, json_valid(raw_generation) AS ok,
        CASE WHEN json_valid(raw_generation) THEN raw_generation ELSE 'null' END AS j FROM raw),
    parsed AS (SELECT sample_id, j AS raw_generation, CASE
        WHEN NOT ok THEN 'invalid_json'
        WHEN json_type(j) <> 'OBJECT' THEN 'output_is_not_a_json_object'
        WHEN list_sort(json_keys(j)) <> ['predicted_emotion_label', 'predicted_narrative'] THEN 'unexpected_keys'
        WHEN json_type(j, '$.predicted_narrative') <> 'VARCHAR' THEN 'predicted_narrative_is_not_a_string'
        WHEN json_type(j, '$.predicted_emotion_label') <> 'VARCHAR' THEN 'predicted_emotion_label_is_not_a_string'
        WHEN {V.norm_sql("json_extract_string(j, '$.predicted_narrative')")} = '' THEN 'predicted_narrative_is_empty'
        WHEN {V.norm_sql("json_extract_string(j, '$.predicted_emotion_label')")} NOT IN {tuple(EMOTION_LABELS)} THEN 'invalid_emotion_label'
        ELSE '' END AS parse_error FROM safe)"""


def raw_generations(spark, sf) -> DataFrame:
    """JSON answers in eight states: valid, cut off, extra key, bad label, blank, number, prose, array."""
    text = F.replace(F.replace(collapse(F.col("text")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    docs = V.documents(spark, sf).select("doc_id", "n_chars", text.alias("t"), V.pick_label(F.col("doc_id")).alias("l"))
    head, mid = F.lit('{"predicted_narrative":"'), F.lit('","predicted_emotion_label":"')
    valid = F.concat(head, "t", mid, "l", F.lit('"}'))
    state = F.pmod("doc_id", F.lit(8))
    forms = {1: F.concat(head, "t", mid, "l", F.lit('"')), 2: F.concat(head, "t", mid, "l", F.lit('","reason":"x"}')),
             3: F.concat(head, "t", mid, F.lit('Annoyance"}')), 4: F.concat(head, F.lit("  "), mid, "l", F.lit('"}')),
             5: F.concat(F.lit('{"predicted_narrative":42,"predicted_emotion_label":"'), "l", F.lit('"}')),
             6: F.concat(F.lit("Sure: "), valid, F.lit(" Done.")), 7: F.concat(F.lit("["), valid, F.lit("]"))}
    raw = valid
    for number, form in forms.items():
        raw = F.when(state == number, form).otherwise(raw)
    return docs.select(F.col("doc_id").alias("sample_id"), "n_chars", raw.alias("raw_generation"))


@query("structured_parse", "T17", f"""WITH {STRICT_SQL} SELECT sample_id, parse_error, parse_error = '' AS parse_success,
    CASE WHEN parse_error = '' THEN {V.norm_sql("json_extract_string(raw_generation, '$.predicted_narrative')")} ELSE '' END AS predicted_narrative,
    CASE WHEN parse_error = '' THEN json_extract_string(raw_generation, '$.predicted_emotion_label') ELSE '' END AS predicted_emotion_label FROM parsed""")
def _(spark, sf):
    return P.parse_strict(raw_generations(spark, sf)).select("sample_id", "parse_error", "parse_success", "predicted_narrative", "predicted_emotion_label")


@query("structured_parse_report", "T17", f"WITH {STRICT_SQL} SELECT parse_error, count(*) AS n FROM parsed GROUP BY 1")
def _(spark, sf):
    return P.parse_report(P.parse_strict(raw_generations(spark, sf)))


@query("generation_failures", "F11", f"WITH {STRICT_SQL} SELECT count(*) FILTER (WHERE parse_error <> '') AS generation_failures FROM parsed")
def _(spark, sf):
    return A.generation_failures(P.parse_strict(raw_generations(spark, sf)))


@query("prediction_completeness", "F12", f"""WITH {STRICT_SQL} SELECT count(*) AS prediction_rows, count(*) FILTER (WHERE parse_error <> '') AS failed_rows,
    (SELECT count(*) FROM documents) AS gold_rows, count(*) = (SELECT count(*) FROM documents) AND count(*) FILTER (WHERE parse_error <> '') = 0 AS complete FROM parsed""")
def _(spark, sf):
    return A.completeness(P.parse_strict(raw_generations(spark, sf)), V.table(spark, sf, "documents"))


def field_sql(name: str) -> str:
    value = f"""trim(regexp_replace(trim(regexp_extract(raw_generation, '(?is)"?{name}"?\\s*[:=]\\s*"?(.*?)"?(?:,|\\n|$)', 1)), '^,+|,+$', '', 'g'))"""
    return V.norm_sql(f"""regexp_replace(regexp_replace(rtrim(regexp_replace({value}, '\\}}$', '')), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')""")


OBJECT_SQL = "regexp_extract(raw_generation, '(?s)\\{.*\\}')"


@query("lenient_parse", "T18", f"""WITH {RAW_SQL}, o AS (SELECT *, {OBJECT_SQL} AS object, {OBJECT_SQL} <> '' AND json_valid({OBJECT_SQL}) AS ok FROM raw),
    p AS (SELECT sample_id, CASE WHEN ok THEN {V.norm_sql("json_extract_string(CASE WHEN ok THEN object ELSE '{}' END, '$.predicted_narrative')")} ELSE {field_sql('predicted_narrative')} END AS predicted_narrative,
        CASE WHEN ok THEN {V.norm_sql("json_extract_string(CASE WHEN ok THEN object ELSE '{}' END, '$.predicted_emotion_label')")} ELSE {field_sql('predicted_emotion_label')} END AS predicted_emotion_label FROM o)
    SELECT *, predicted_narrative <> '' OR predicted_emotion_label <> '' AS parse_success FROM p""")
def _(spark, sf):
    return P.parse_lenient(raw_generations(spark, sf)).select("sample_id", "predicted_narrative", "predicted_emotion_label", "parse_success")


TWO_LINE_SQL = f"""two AS (SELECT doc_id AS sample_id, CASE doc_id % 6 WHEN 1 THEN 'Emotion: joyful' || chr(10) || 'Narrative: ' || t
    WHEN 2 THEN 'Marker: X' || chr(10) || 'Narrative: ' || t WHEN 3 THEN 'Narrative: ' || t || chr(10) || 'second line'
    WHEN 4 THEN '  Emotion: Fear' || chr(10) || t WHEN 5 THEN 'Sadness' || chr(10) || t
    ELSE 'Emotion: Joy' || chr(10) || 'Narrative: ' || t || ' ' END AS raw_generation FROM (SELECT doc_id, {V.norm_sql('text')} AS t FROM documents))"""


def two_line(spark, sf) -> DataFrame:
    docs = V.documents(spark, sf).select("doc_id", collapse(F.col("text")).alias("t"))
    state = F.pmod("doc_id", F.lit(6))
    raw = (F.when(state == 1, F.concat(F.lit("Emotion: joyful\nNarrative: "), "t")).when(state == 2, F.concat(F.lit("Marker: X\nNarrative: "), "t"))
           .when(state == 3, F.concat(F.lit("Narrative: "), "t", F.lit("\nsecond line"))).when(state == 4, F.concat(F.lit("  Emotion: Fear\n"), "t"))
           .when(state == 5, F.concat(F.lit("Sadness\n"), "t")).otherwise(F.concat(F.lit("Emotion: Joy\nNarrative: "), "t", F.lit(" "))))
    return docs.select(F.col("doc_id").alias("sample_id"), raw.alias("raw_generation"))


def _two_line_columns(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "predicted_narrative", "predicted_emotion_label", "parse_success")


LABELS_RE = "|".join(EMOTION_LABELS)


@query("two_line_joint_parse", "T19", f"""WITH {TWO_LINE_SQL}, p AS (SELECT sample_id,
    trim(regexp_extract(trim(raw_generation), '^Emotion: ({LABELS_RE})\\nNarrative: (.+)$', 2)) AS predicted_narrative,
    regexp_extract(trim(raw_generation), '^Emotion: ({LABELS_RE})\\nNarrative: (.+)$', 1) AS predicted_emotion_label FROM two)
    SELECT *, predicted_narrative <> '' OR predicted_emotion_label <> '' AS parse_success FROM p""")
def _(spark, sf):
    return _two_line_columns(P.parse_two_line(two_line(spark, sf), form="joint"))


@query("two_line_marker_parse", "T19", f"""WITH {TWO_LINE_SQL}, p AS (SELECT sample_id, trim(regexp_extract(trim(raw_generation), '^Marker: X\\nNarrative: (.+)$', 1)) AS predicted_narrative,
    '' AS predicted_emotion_label FROM two) SELECT *, predicted_narrative <> '' AS parse_success FROM p""")
def _(spark, sf):
    return _two_line_columns(P.parse_two_line(two_line(spark, sf), form="marker"))


LOOSE_LABEL_SQL = "CASE " + " ".join(
    f"WHEN starts_with(lower(trim(regexp_extract(raw_generation, 'Emotion:\\s*(.+)', 1))), '{x.lower()}') THEN '{x}'" for x in EMOTION_LABELS) + " ELSE '' END"


@query("two_line_loose_parse", "T19", f"""WITH {TWO_LINE_SQL}, p AS (SELECT sample_id, regexp_replace(CASE WHEN contains(raw_generation, 'Narrative:')
        THEN regexp_extract(raw_generation, '(?s)Narrative:(.*)', 1) ELSE regexp_replace(raw_generation, '^\\s*Emotion:.*(?:\\n|$)', '') END, '^\\s+|\\s+$', '', 'g') AS predicted_narrative,
    {LOOSE_LABEL_SQL} AS predicted_emotion_label FROM two) SELECT *, predicted_narrative <> '' OR predicted_emotion_label <> '' AS parse_success FROM p""")
def _(spark, sf):
    return _two_line_columns(P.parse_two_line(two_line(spark, sf), form="loose"))


@query("label_line_parse", "T19", f"""WITH {TWO_LINE_SQL}, p AS (SELECT sample_id, '' AS predicted_narrative,
    CASE WHEN trim(split_part(trim(raw_generation), chr(10), 1)) IN {tuple(EMOTION_LABELS)} THEN trim(split_part(trim(raw_generation), chr(10), 1)) ELSE '' END AS predicted_emotion_label FROM two)
    SELECT *, predicted_emotion_label <> '' AS parse_success FROM p""")
def _(spark, sf):
    return _two_line_columns(P.parse_two_line(two_line(spark, sf), form="label"))


# --- judge, argument and manual summaries ----------------------------------------------------
JUDGE_SQL = """judge AS (SELECT doc_id AS sample_id, CASE WHEN n_chars % 29 = 0 THEN NULL ELSE 1 + n_chars % 5 END AS relevance,
    1 + (n_chars * 3 + doc_id) % 5 AS faithfulness, 1 + (n_chars * 2 + doc_id) % 5 AS coherence,
    CASE WHEN n_chars % 29 = 0 THEN NULL ELSE ['contradiction','entailment','neutral'][CAST(n_chars % 3 + 1 AS INTEGER)] END AS nli_label FROM documents)"""


def judged(spark, sf) -> DataFrame:
    n, doc = F.col("n_chars"), F.col("doc_id")
    known = n % 29 != 0
    return V.table(spark, sf, "documents").select(
        doc.alias("sample_id"), F.when(known, 1 + n % 5).alias("relevance_score"), (1 + (n * 3 + doc) % 5).alias("faithfulness_score"),
        (1 + (n * 2 + doc) % 5).alias("coherence_score"),
        F.when(known, F.element_at(F.array(*[F.lit(x) for x in ("contradiction", "entailment", "neutral")]), (n % 3 + 1).cast("int"))).alias("nli_label"))


@query("judge_means", "A19", f"""WITH {JUDGE_SQL} SELECT 'judge_relevance_mean' AS metric, round(avg(relevance), 9) AS value FROM judge
    UNION ALL SELECT 'judge_faithfulness_mean', round(avg(faithfulness), 9) FROM judge UNION ALL SELECT 'judge_coherence_mean', round(avg(coherence), 9) FROM judge""")
def _(spark, sf):
    return rounded(J.judge_summary(judged(spark, sf)))


@query("judge_label_shares", "A18", f"""WITH {JUDGE_SQL} SELECT nli_label AS value, round_even(count(*) / (sum(count(*)) OVER ())::DOUBLE, 4) AS share FROM judge WHERE nli_label IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return L.relative_distribution(judged(spark, sf), "nli_label")


@query("argument_rates", "A20", """SELECT 'argument_claim_rate' AS metric, round(avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0 END), 9) AS value FROM documents
    UNION ALL SELECT 'argument_reason_rate', round(avg(CASE WHEN contains(text, 'the') THEN 1.0 ELSE 0 END), 9) FROM documents
    UNION ALL SELECT 'argument_stance_rate', round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0 END), 9) FROM documents""")
def _(spark, sf):
    flags = V.table(spark, sf, "documents").select(F.col("text").contains("!").alias("has_claim"), F.col("text").contains("the").alias("has_reason"),
                                                    F.col("text").contains("?").alias("has_stance_marker"))
    return rounded(J.argument_summary(flags))


@query("manual_score_means", "A21 T11", """SELECT 'manual_relevance_mean' AS metric, round(avg(TRY_CAST(substr(source, 4) AS DOUBLE)), 9) AS value FROM documents
    UNION ALL SELECT 'manual_grammar_mean', round(avg(TRY_CAST(lang AS DOUBLE)), 9) FROM documents""")
def _(spark, sf):
    sheet = V.table(spark, sf, "documents").select(F.substring("source", 4, 20).alias("manual_relevance"), F.col("lang").alias("manual_grammar"))
    return rounded(J.manual_summary(sheet))


@query("score_cache_lookup", "J14", """
    WITH k AS (SELECT doc_id, sha256(concat_ws(':', doc_id, 'judge', 'v1', sha256(text))) AS cache_key FROM documents)
    SELECT k.doc_id AS sample_id, k.cache_key, CASE WHEN l.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS state FROM k LEFT JOIN labels l ON l.doc_id = k.doc_id""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    keyed = docs.select("sample_id", J.cache_key(F.col("sample_id"), "judge", "v1", F.col("text")).alias("cache_key"))
    cache = keyed.join(V.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality"), "sample_id").select("cache_key", "quality")
    stored_cache = ScoreCache(spark, scratch_path(spark, "score-cache"), "quality int")
    stored_cache.append(cache)
    hits, misses = stored_cache.lookup(keyed)
    return hits.select("sample_id", "cache_key", F.lit("hit").alias("state")).unionByName(misses.select("sample_id", "cache_key", F.lit("miss").alias("state")))


# --- clients ---------------------------------------------------------------------------------

def echo_client():
    """Deterministic stand-in for a model: answers with the prompt, fails on question marks."""
    def call(prompt: str) -> tuple[str, str]:
        if "?" in prompt:
            raise ValueError("question")
        return json.dumps({"predicted_narrative": prompt, "predicted_emotion_label": "Joy"}, ensure_ascii=False), "stop"
    return call


@query("generated_predictions", "UDF1", f"""SELECT doc_id AS sample_id, CASE WHEN contains(text, '?') THEN '' ELSE {V.norm_sql('text')} END AS predicted_narrative,
    CASE WHEN contains(text, '?') THEN '' ELSE 'Joy' END AS predicted_emotion_label, NOT contains(text, '?') AS parse_success,
    CASE WHEN contains(text, '?') THEN 'ValueError: question' ELSE '' END AS request_error, CASE WHEN contains(text, '?') THEN '' ELSE 'stop' END AS finish_reason
    FROM documents""")
def _(spark, sf):
    docs = V.documents(spark, sf).select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prompt"))
    out = G.generate_predictions(docs, "prompt", echo_client, "echo", "stub_run")
    return out.select("sample_id", "predicted_narrative", "predicted_emotion_label", "parse_success", "request_error", "finish_reason")


def length_judge():
    """Deterministic judge: scores from the length of the prompt; the first try of a task fails."""
    state = {"failed": False}

    def call(prompt: str) -> tuple[str, str]:
        if not state["failed"]:
            state["failed"] = True
            raise TimeoutError("first call")
        return json.dumps({"relevance_score": 1 + len(prompt) % 5, "nli_label": "neutral"}), "stop"
    return call


@query("scored_with_cache", "UDF2 J14", """SELECT d.doc_id AS sample_id, CAST(coalesce(l.quality, 1 + length(text) % 5) AS INTEGER) AS relevance_score,
    CASE WHEN l.doc_id IS NULL THEN 'neutral' ELSE 'cached' END AS nli_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    docs = V.documents(spark, sf).select(F.col("doc_id").alias("sample_id"), "text")
    rows = docs.withColumn("cache_key", J.cache_key(F.col("sample_id"), "judge", "v1", F.col("text")))
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("relevance_score"))
    cache = rows.join(labels, "sample_id").select("cache_key", "relevance_score", F.lit("cached").alias("nli_label"))

    def score(misses: DataFrame) -> DataFrame:
        return misses.join(G.score_rows(misses, "text", length_judge, "relevance_score int, nli_label string"), "sample_id")

    stored_cache = ScoreCache(spark, scratch_path(spark, "score-cache"), "relevance_score int, nli_label string")
    stored_cache.append(cache)
    return score_with_stored_cache(rows, stored_cache, score).select("sample_id", "relevance_score", "nli_label")


@query("token_budget_batches", "W10")
def _(spark, sf):
    shard = F.floor(F.col("doc_id") / 1000).alias("shard")
    sized = V.documents(spark, sf).select(shard, "doc_id", F.size(tokens_13a(F.col("text"))).alias("tokens"))
    return G.token_batches(sized, "shard", "doc_id", "tokens", 16, 8192)


# --- summaries of a run ----------------------------------------------------------------------

@query("backend_agreement", "J10 A34", V.with_views(["aligned"], rf"""
    , b AS (SELECT sample_id, predicted_emotion_label AS la, emotion_label AS lb, predicted_narrative AS na, reference_narrative AS nb FROM aligned)
    SELECT count(*) AS n, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0 END), 9) AS label_exact_match, count(*) FILTER (WHERE la <> lb) AS label_differences,
           round(avg(CASE WHEN trim(na) = trim(nb) THEN 1.0 ELSE 0 END), 9) AS narrative_exact_match,
           round(avg(len(list_filter(string_split(na, ' '), lambda w: w <> ''))), 9) AS words_mean,
           round(quantile_cont(len(list_filter(string_split(na, ' '), lambda w: w <> ''))::DOUBLE, 0.95), 9) AS words_p95,
           CAST(max(len(list_filter(string_split(regexp_replace({V.norm_sql('na')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))) AS INTEGER) AS max_sentences FROM b"""))
def _(spark, sf):
    from narralytics.functions.text import sentences, word_count
    a = V.aligned(spark, sf).select("sample_id", "reference_narrative", F.col("predicted_emotion_label").alias("predicted_emotion_label"), "predicted_narrative")
    b = V.gold(spark, sf).select("sample_id", "reference_narrative", F.col("emotion_label").alias("predicted_emotion_label"), F.col("reference_narrative").alias("predicted_narrative"))
    shared = b.join(a.select("sample_id"), "sample_id", "left_semi")
    pairs = A.pair_runs(a, shared)
    return rounded(A.agreement(pairs, F.size(sentences(F.col("predicted_narrative_a"))), word_count(F.col("predicted_narrative_a"))))


@query("run_summary_long", "IO11 U1", V.with_views(["label_scores"], f"""
    , acc AS (SELECT sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS v FROM cells), f AS (SELECT avg(f1) AS v FROM label_scores)
    SELECT 'accuracy' AS metric, round(v, 9) AS value FROM acc UNION ALL SELECT 'emotion_accuracy', round(v, 9) FROM acc
    UNION ALL SELECT 'macro_f1', round(v, 9) FROM f UNION ALL SELECT 'emotion_macro_f1', round(v, 9) FROM f
    UNION ALL SELECT 'num_aligned_rows', count(*)::DOUBLE FROM aligned"""))
def _(spark, sf):
    both = V.aligned(spark, sf)
    cells = L.cell_counts(both)
    metrics = L.label_summary(cells).where(F.col("metric").isin("accuracy", "macro_f1"))
    counts = cells.agg(F.sum("n").cast("double").alias("value")).select(F.lit("num_aligned_rows").alias("metric"), "value")
    stale = counts.withColumn("value", F.lit(-1.0))
    return rounded(R.build_summary([stale, metrics, None, counts]))


@query("summary_recheck", "A13 F9", V.with_views(["aligned"], """
    , parts AS (SELECT 'all' AS rows, * FROM aligned UNION ALL SELECT 'without_toxic', * FROM aligned WHERE sample_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    c AS (SELECT rows, emotion_label AS gold, predicted_emotion_label AS pred, count(*) AS n FROM parts GROUP BY ALL),
    s AS (SELECT rows, label, sum(tp)::DOUBLE AS tp, sum(g)::DOUBLE AS g, sum(p)::DOUBLE AS p FROM (
        SELECT rows, gold AS label, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS g, 0 AS p FROM c UNION ALL SELECT rows, pred, 0, 0, n FROM c) GROUP BY ALL),
    f AS (SELECT rows, avg(coalesce(2 * tp / nullif(g + p, 0), 0)) AS a, avg(coalesce(2 * (tp / nullif(p, 0)) * (tp / nullif(g, 0)) / nullif(tp / nullif(p, 0) + tp / nullif(g, 0), 0), 0)) AS b FROM s GROUP BY rows),
    x AS (SELECT rows, sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS a FROM c GROUP BY rows),
    y AS (SELECT rows, avg(CASE WHEN emotion_label = predicted_emotion_label THEN 1.0 ELSE 0 END) AS b FROM parts GROUP BY rows),
    d AS (SELECT rows, greatest(abs(x.a - y.b), abs(f.a - f.b)) AS m FROM x JOIN y USING (rows) JOIN f USING (rows))
    SELECT rows, round(m, 9) AS max_difference, 2::BIGINT AS metrics, m <= 1e-9 AS equal FROM d"""))
def _(spark, sf):
    """Stored summaries of all rows and of the rows left after an exclusion, recomputed row by row."""
    both = V.aligned(spark, sf).select("sample_id", L.GOLD, L.PRED)
    toxic = V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    parts = both.withColumn("rows", F.lit("all")).unionByName(A.exclude_ids([both], toxic)[0].withColumn("rows", F.lit("without_toxic")))
    cells = L.cell_counts(parts, ["rows"])
    of = lambda name: L.label_summary(cells.where(F.col("rows") == name).drop("rows")).where("metric IN ('accuracy', 'macro_f1')").withColumn("rows", F.lit(name))
    accuracy = L.accuracy(parts, ["rows"]).select("rows", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    harmonic = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    macro = L.label_scores(cells, ["rows"]).groupBy("rows").agg(F.avg(harmonic).alias("value")).select("rows", F.lit("macro_f1").alias("metric"), "value")
    return rounded(R.check_summary(accuracy.unionByName(macro), of("all").unionByName(of("without_toxic")), by=["rows"]))
