"""Training-table preparation and leakage audits over documents and benchmark items."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.registry import query
from narralytics.catalog.text_queries import KEY_SQL, tokens_13a_sql
from narralytics.constants import EMOTION_LABELS
from narralytics.operators import align as A
from narralytics.operators import audits as U
from narralytics.operators import prep as P
from narralytics.session import stored

HASH_SQL = "md5(concat_ws(':', '{seed}', doc_id))"
LABEL_SQL = V.label_sql("d.doc_id")
POOL_SQL = f"""pool AS (
    SELECT d.doc_id, {V.norm_sql('d.text')} AS text, CASE WHEN l.toxic = 1 AND l.quality = 0 THEN '' ELSE {LABEL_SQL} END AS label,
           CASE WHEN l.toxic = 1 THEN '' ELSE {V.norm_sql('d.text')} END AS narrative
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SPLIT_SQL = POOL_SQL + f""", required AS (SELECT * FROM pool WHERE text <> '' AND label <> ''),
    deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY doc_id) AS rn FROM required) WHERE rn = 1),
    split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {HASH_SQL.format(seed=42)}, doc_id)
        <= greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.05::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM deduped)"""
KEY_OF = lambda c: f"lower(replace({V.norm_sql(c)}, 'ß', 'ss'))"
ALL_SPLITS_SQL = SPLIT_SQL + f""", splits AS (
    SELECT split, text AS source_text, narrative AS reference_narrative FROM split
    UNION ALL SELECT 'stage1', text, text FROM benchmark
    UNION ALL SELECT 'manual', text, '' FROM conversations
    UNION ALL SELECT 'manual', d.text, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1),
    digests AS (SELECT split, 'source' AS kind, sha256({KEY_OF('source_text')}) AS key FROM splits WHERE {V.norm_sql('source_text')} <> ''
        UNION ALL SELECT split, 'narrative', sha256({KEY_OF('reference_narrative')}) FROM splits WHERE {V.norm_sql('reference_narrative')} <> '')"""


def pool(spark, sf) -> DataFrame:
    joined = V.documents(spark, sf).select("doc_id", "text").join(V.table(spark, sf, "labels"), "doc_id", "left")
    text = P.collapse(F.col("text"))
    return joined.select(
        "doc_id", text.alias("text"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("")).otherwise(V.pick_label(F.col("doc_id"))).alias("label"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(text).alias("narrative"))


def split(spark, sf) -> DataFrame:
    return P.deduplicated_split(P.required_rows(pool(spark, sf), "text", "label"), "text", "label", "doc_id")


def all_splits(spark, sf) -> DataFrame:
    cols = ["split", "source_text", "reference_narrative"]
    trained = split(spark, sf).select("split", F.col("text").alias("source_text"), F.col("narrative").alias("reference_narrative"))
    items = V.table(spark, sf, "benchmark").select(F.lit("stage1"), "text", "text").toDF(*cols)
    turns = V.table(spark, sf, "conversations").select(F.lit("manual"), "text", F.lit("")).toDF(*cols)
    toxic = V.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    flagged = V.table(spark, sf, "documents").join(toxic, "doc_id").select(F.lit("manual"), "text", "text").toDF(*cols)
    return trained.unionByName(items).unionByName(turns).unionByName(flagged)


@query("required_rows", "F7", f"WITH {POOL_SQL} SELECT doc_id, label, length(text) AS chars FROM pool WHERE text <> '' AND label <> ''")
def _(spark, sf):
    return P.required_rows(pool(spark, sf), "text", "label").select("doc_id", "label", F.length("text").alias("chars"))


@query("blank_text_counts", "F8", f"WITH {POOL_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE narrative = '') AS missing FROM pool")
def _(spark, sf):
    return P.blank_counts(pool(spark, sf), "narrative")


@query("deduplicated_first", "W1", f"WITH {SPLIT_SQL} SELECT doc_id, label FROM deduped")
def _(spark, sf):
    return P.keep_first(P.required_rows(pool(spark, sf), "text", "label"), "text", "doc_id").select("doc_id", "label")


@query("stratified_split", "W2 W1", f"WITH {SPLIT_SQL} SELECT doc_id, label, split FROM split")
def _(spark, sf):
    return split(spark, sf).select("doc_id", "label", "split")


@query("split_summary", "A27 A17", f"""WITH {SPLIT_SQL}
    SELECT 'source_rows' AS item, count(*) AS value FROM pool
    UNION ALL SELECT 'rows_after_required_field_filter', count(*) FROM required
    UNION ALL SELECT 'rows_after_deduplication', count(*) FROM deduped
    UNION ALL SELECT 'label_' || s || '_rows', (SELECT count(*) FROM split WHERE split = s) FROM (VALUES ('train'), ('validation')) t(s)
    UNION ALL SELECT 'narrative_' || s || '_rows', (SELECT count(*) FROM split WHERE split = s AND narrative <> '') FROM (VALUES ('train'), ('validation')) t(s)
    UNION ALL SELECT s || '_' || v, count(p.doc_id) FROM (VALUES ('train'), ('validation')) t(s)
        CROSS JOIN (SELECT unnest({V.LABEL_LIST_SQL}) AS v) LEFT JOIN split p ON p.split = s AND p.label = v GROUP BY s, v""")
def _(spark, sf):
    source = pool(spark, sf)
    required = P.required_rows(source, "text", "label")
    return P.split_summary(source, required, split(spark, sf), "label", "narrative")


@query("alpaca_rows", "F13", f"""WITH {SPLIT_SQL} SELECT 'You label comments.' AS system, 'Name the emotion.' AS instruction,
    text AS input, label AS output FROM split WHERE split = 'train'""")
def _(spark, sf):
    return P.alpaca_rows(split(spark, sf).where("split = 'train'"), "You label comments.", "Name the emotion.", "text", "label")


def _tasks(spark, sf):
    rows = stored(split(spark, sf), "split")    # both tasks and the check of the pairing read it
    labels = P.alpaca_rows(rows, "Label system", "Label instruction", "text", "label")
    narratives = P.alpaca_rows(rows.where("narrative <> ''"), "Narrative system", "Narrative instruction", "text", "narrative")
    return P.pair_tasks(labels, narratives)


@query("task_pairing", "J7 J8", f"""WITH {SPLIT_SQL}
    SELECT text AS source_text, label AS emotion_label, nullif(narrative, '') AS reference_narrative, 'Label system' AS label_system,
           CASE WHEN narrative <> '' THEN 'Narrative instruction' END AS narrative_instruction FROM split""")
def _(spark, sf):
    return _tasks(spark, sf).select("source_text", "emotion_label", "reference_narrative", "label_system", "narrative_instruction")


@query("task_pairing_summary", "J7", f"""WITH {SPLIT_SQL}
    SELECT count(*) AS label_rows, count(*) FILTER (WHERE narrative <> '') AS paired_rows,
           count(*) FILTER (WHERE narrative = '') AS label_rows_without_narrative FROM split""")
def _(spark, sf):
    return P.pairing_summary(_tasks(spark, sf))


@query("duplicate_keys", "J8", f"""
    SELECT sha256({KEY_SQL}) AS key, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    keyed = V.documents(spark, sf).select(P.key_digest(F.col("text")).alias("key"))
    return A.duplicate_keys(keyed, ["key"])


CONDITIONS = ["true", "forced_wrong", "constant_neutral", "marker_control"]
WRONG_SQL = V.label_sql("doc_id + 3")
TARGETS_SQL = f"""targets AS (
    SELECT doc_id AS sample_id, condition, CASE condition WHEN 'marker_control' THEN 'Marker: X' WHEN 'constant_neutral' THEN 'Emotion: Neutral'
        WHEN 'forced_wrong' THEN 'Emotion: ' || {WRONG_SQL} ELSE 'Emotion: ' || label END || chr(10) || 'Narrative: ' || trim(narrative) AS output
    FROM pool, (SELECT unnest(['true','forced_wrong','constant_neutral','marker_control']) AS condition))"""


def _targets(spark, sf):
    rows = pool(spark, sf).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    return rows.select(F.col("doc_id").alias("sample_id"), "condition", P.target_text(
        F.col("condition"), F.col("label"), V.pick_label(F.col("doc_id") + 3), F.col("narrative")).alias("output"))


@query("condition_targets", "F14", f"WITH {POOL_SQL}, {TARGETS_SQL} SELECT * FROM targets")
def _(spark, sf):
    return _targets(spark, sf)


@query("gold_conditioned_prompt", "F15", f"""WITH {POOL_SQL}
    SELECT doc_id, 'The author''s dominant emotion is ' || label || '.' || chr(10) || 'Extract it.' || chr(10) || text AS prompt FROM pool""")
def _(spark, sf):
    prompt = F.concat(P.gold_prefix(F.col("label"), F.lit("Extract it.")), F.lit("\n"), F.col("text"))
    return pool(spark, sf).select("doc_id", prompt.alias("prompt"))


LENGTHS_SQL = f"""lengths AS (SELECT sample_id, condition, len({tokens_13a_sql('output')}) AS n FROM targets)"""


def _lengths(spark, sf):
    sized = P.target_tokens(pool(spark, sf), CONDITIONS, F.col("label"), V.pick_label(F.col("doc_id") + 3), F.col("narrative"))
    return sized.select(F.col("doc_id").alias("sample_id"), "condition", "n")


@query("length_profile", "A14", f"""WITH {POOL_SQL}, {TARGETS_SQL}, {LENGTHS_SQL}
    SELECT condition, count(*) AS rows, CAST(min(n) AS INTEGER) AS minimum, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median,
           round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95,
           round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99, CAST(max(n) AS INTEGER) AS maximum, count(*) FILTER (WHERE n > 1024) AS over_1024,
           count(*) FILTER (WHERE n > 1536) AS over_1536, count(*) FILTER (WHERE n > 2048) AS over_2048 FROM lengths GROUP BY condition""")
def _(spark, sf):
    out = P.length_profile(_lengths(spark, sf), "n", ["condition"])
    return out.select(*[F.round(c, 6).alias(c) if c in ("median", "p90", "p95", "p99") else F.col(c) for c in out.columns])


@query("length_deltas", "A16", f"""WITH {POOL_SQL}, {TARGETS_SQL}, {LENGTHS_SQL}
    SELECT a.condition, CAST(min(a.n - b.n) AS INTEGER) AS minimum_delta, quantile_cont((a.n - b.n)::DOUBLE, 0.5) AS median_delta,
           CAST(max(a.n - b.n) AS INTEGER) AS maximum_delta, count(*) FILTER (WHERE (a.n > 1024) <> (b.n > 1024)) AS different_cutoff_rows
    FROM lengths a JOIN lengths b ON b.sample_id = a.sample_id AND b.condition = 'true' WHERE a.condition <> 'true' GROUP BY a.condition""")
def _(spark, sf):
    return P.length_deltas(_lengths(spark, sf), "true", 1024)


TASK_SQL = f"""paired AS (SELECT doc_id, text, label, narrative FROM split WHERE narrative <> ''),
    cut AS (SELECT *, {tokens_13a_sql('text')} AS s FROM paired),
    tasks AS (SELECT doc_id, 'label' AS task, len(s) > 512 AS truncated, 'Label system' AS sys,
                     'Label instruction' || chr(10) || CASE WHEN len(s) > 512 THEN array_to_string(s[1:512], ' ') ELSE text END AS prompt, label AS target FROM cut
              UNION ALL SELECT doc_id, 'narrative', len(s) > 512, 'Narrative system',
                     'Narrative instruction' || chr(10) || CASE WHEN len(s) > 512 THEN array_to_string(s[1:512], ' ') ELSE text END, narrative FROM cut),
    sized AS (SELECT *, len({tokens_13a_sql("(sys || chr(10) || prompt)")}) AS p, len({tokens_13a_sql('target')}) AS t FROM tasks),
    rows AS (SELECT doc_id, task, truncated, p AS prompt_tokens, least(p + t, 1536) AS sequence_tokens, greatest(least(p + t, 1536) - p, 0) AS target_tokens FROM sized)"""


def _task_rows(spark, sf):
    return P.task_rows(_tasks(spark, sf).where("reference_narrative is not null"), 512, 1536)


@query("task_rows", "F16 T15", f"""WITH {SPLIT_SQL}, {TASK_SQL}
    SELECT task, truncated, CAST(prompt_tokens AS INTEGER) AS prompt_tokens, CAST(sequence_tokens AS INTEGER) AS sequence_tokens,
           CAST(target_tokens AS INTEGER) AS target_tokens FROM rows""")
def _(spark, sf):
    return _task_rows(spark, sf).select("task", "truncated", "prompt_tokens", "sequence_tokens", "target_tokens")


@query("task_row_summary", "A15", f"""WITH {SPLIT_SQL}, {TASK_SQL}
    SELECT count(*) FILTER (WHERE task = 'label') AS paired_rows, count(*) AS sequences,
           count(*) FILTER (WHERE task = 'label' AND truncated) AS truncated_sources,
           round(avg(target_tokens) FILTER (WHERE task = 'label'), 6) AS label_target_tokens_mean,
           round(avg(target_tokens) FILTER (WHERE task = 'narrative'), 6) AS narrative_target_tokens_mean,
           CAST(max(sequence_tokens) FILTER (WHERE task = 'label') AS INTEGER) AS label_sequence_tokens_max,
           CAST(max(sequence_tokens) FILTER (WHERE task = 'narrative') AS INTEGER) AS narrative_sequence_tokens_max FROM rows""")
def _(spark, sf):
    out = P.task_summary(_task_rows(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("mean") else F.col(c) for c in out.columns])


CELLS_SQL = f"""pairs AS (SELECT {V.label_sql('doc_id')} AS l, CASE WHEN l.quality = 0 THEN {V.label_sql('doc_id * 3')} ELSE {V.label_sql('doc_id')} END AS r
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _label_pairs(spark, sf):
    joined = V.table(spark, sf, "documents").select("doc_id").join(V.table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(V.pick_label(F.col("doc_id")).alias("l"),
                         F.when(F.col("quality") == 0, V.pick_label(F.col("doc_id") * 3)).otherwise(V.pick_label(F.col("doc_id"))).alias("r"))


@query("label_mutual_information", "A30", f"""WITH {CELLS_SQL},
    c AS (SELECT l, r, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS total FROM pairs GROUP BY l, r),
    ml AS (SELECT l, sum(n) AS n FROM c GROUP BY l), mr AS (SELECT r, sum(n) AS n FROM c GROUP BY r),
    i AS (SELECT sum(c.n / total * ln(c.n / total / (ml.n / total * mr.n / total))) AS information, max(total) AS total FROM c JOIN ml USING (l) JOIN mr USING (r))
    SELECT round(information, 9) AS information, round(information / sqrt(
        (SELECT -sum(n / (SELECT total FROM i) * ln(n / (SELECT total FROM i))) FROM ml) *
        (SELECT -sum(n / (SELECT total FROM i) * ln(n / (SELECT total FROM i))) FROM mr)), 9) AS normalized FROM i""")
def _(spark, sf):
    out = P.mutual_information(_label_pairs(spark, sf), "l", "r")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("label_contingency_wide", "A31", f"WITH {CELLS_SQL} SELECT l AS \"left\", " + ", ".join(
    f"count(*) FILTER (WHERE r = '{x}') AS \"{x}\"" for x in EMOTION_LABELS) + " FROM pairs GROUP BY l")
def _(spark, sf):
    return P.contingency_wide(_label_pairs(spark, sf), "l", "r", EMOTION_LABELS)


@query("label_change_counts", "A31", f"""WITH {CELLS_SQL}
    SELECT v AS label, count(*) FILTER (WHERE l = v) AS before, count(*) FILTER (WHERE r = v) AS after,
           count(*) FILTER (WHERE l = v AND r = v) AS matches FROM pairs, (SELECT unnest({V.LABEL_LIST_SQL}) AS v) GROUP BY v""")
def _(spark, sf):
    return P.label_change_counts(_label_pairs(spark, sf), "l", "r")


@query("permuted_labels", "W11", f"""
    WITH rows AS (SELECT doc_id, {V.label_sql('doc_id * 5 + length(text)')} AS label, row_number() OVER (ORDER BY doc_id) AS a,
                         row_number() OVER (ORDER BY {HASH_SQL.format(seed=1234)}, doc_id) AS b FROM documents)
    SELECT x.doc_id, x.label, y.label AS permuted, x.label = y.label AS unchanged FROM rows x JOIN rows y ON y.b = x.a""")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", V.pick_label(F.col("doc_id") * 5 + F.length("text")).alias("label"))
    return P.permute_labels(rows, "label", "doc_id").withColumn("unchanged", F.col("label") == F.col("permuted"))


@query("forced_wrong_labels", "R17 A31", f"""
    SELECT label, count(*) AS before, count(*) AS after, 0::BIGINT AS matches
    FROM (SELECT {V.label_sql('doc_id * 5 + length(text)')} AS label FROM documents) GROUP BY label""")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", V.pick_label(F.col("doc_id") * 5 + F.length("text")).alias("label"))
    return P.label_change_counts(P.forced_wrong_labels(rows, "label", "doc_id", 20260819), "label", "assigned")


@query("longest_first", "S2", f"SELECT doc_id, length({V.norm_sql('text')}) AS chars FROM documents ORDER BY 2 DESC, 1 LIMIT 100")
def _(spark, sf):
    rows = V.documents(spark, sf).select("doc_id", P.collapse(F.col("text")).alias("text"))
    return P.longest_first(rows, "text", "doc_id", 100).select("doc_id", F.length("text").alias("chars"))


@query("overlap_audit", "A32", f"""WITH {ALL_SPLITS_SQL}
    , pairs(a, b) AS (VALUES {", ".join(str(p) for p in U.SPLIT_PAIRS)}), d AS (SELECT DISTINCT * FROM digests),
    kinds AS (SELECT unnest(['source', 'narrative']) AS kind)
    SELECT k.kind, a || '_vs_' || b AS pair, (SELECT count(*) FROM d x JOIN d y ON y.kind = x.kind AND y.key = x.key
        WHERE x.kind = k.kind AND x.split = a AND y.split = b) AS shared FROM pairs, kinds k""")
def _(spark, sf):
    return U.overlap_audit(all_splits(spark, sf))


@query("leakage_gate", "A32", f"""WITH {ALL_SPLITS_SQL}
    SELECT count(*) = 0 AS training_leakage_passed FROM digests x JOIN digests y ON y.kind = x.kind AND y.key = x.key
    WHERE (x.split IN ('train', 'validation') AND y.split IN ('stage1', 'manual'))
       OR (x.kind = 'source' AND x.split = 'train' AND y.split = 'validation')""")
def _(spark, sf):
    return U.leakage_passed(U.overlap_audit(all_splits(spark, sf)))


@query("split_fingerprints", "A33 IO12", f"""WITH {ALL_SPLITS_SQL}
    SELECT split, count(*) FILTER (WHERE kind = 'source') AS rows, count(DISTINCT key) FILTER (WHERE kind = 'source') AS unique_sources,
           count(DISTINCT key) FILTER (WHERE kind = 'narrative') AS unique_narratives,
           CAST(sum(('0x' || substr(key, 1, 12))::BIGINT) FILTER (WHERE kind = 'source') AS VARCHAR) AS source_print,
           CAST(sum(('0x' || substr(key, 1, 12))::BIGINT) FILTER (WHERE kind = 'narrative') AS VARCHAR) AS narrative_print
    FROM digests GROUP BY split""")
def _(spark, sf):
    return U.split_fingerprints(all_splits(spark, sf))


@query("shared_test_sources", "J9", f"""
    WITH s AS (SELECT d.doc_id, {KEY_OF('d.text')} AS key, {V.label_sql('d.doc_id')} AS label FROM documents d),
    a AS (SELECT key, min(doc_id) AS id FROM s WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY key),
    b AS (SELECT key, min(doc_id) AS id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY key)
    SELECT a.id AS sample_id_left, b.id AS sample_id_right, {V.label_sql('a.id')} = {V.label_sql('b.id')} AS same_label
    FROM a JOIN b ON a.key = b.key""")
def _(spark, sf):
    docs = V.documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("source_text"), V.pick_label(F.col("doc_id")).alias("emotion_label"),
        F.col("text").alias("reference_narrative"))
    covered = V.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    pairs = A.shared_sources(docs.join(covered, "sample_id", "left_semi"), docs.join(covered, "sample_id", "left_anti"), check=False)
    return pairs.select("sample_id_left", "sample_id_right", (F.col("emotion_label_left") == F.col("emotion_label_right")).alias("same_label"))


@query("shared_source_agreement", "J9", f"""
    WITH s AS (SELECT d.doc_id, {KEY_OF('d.text')} AS key, {V.label_sql('d.doc_id')} AS label FROM documents d),
    a AS (SELECT key, min(doc_id) AS id FROM s WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY key),
    b AS (SELECT key, min(doc_id) AS id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY key),
    n AS (SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS x, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS y FROM s)
    SELECT round(count(*) / (SELECT greatest(1, least(x, y)) FROM n)::DOUBLE, 9) AS share_of_smaller, count(*) AS shared_sources,
           count(*) FILTER (WHERE {V.label_sql('a.id')} = {V.label_sql('b.id')}) AS label_agreements, count(*) AS narrative_agreements
    FROM a JOIN b ON a.key = b.key""")
def _(spark, sf):
    docs = V.documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("source_text"), V.pick_label(F.col("doc_id")).alias("emotion_label"),
        F.col("text").alias("reference_narrative"))
    covered = V.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    left, right = docs.join(covered, "sample_id", "left_semi"), docs.join(covered, "sample_id", "left_anti")
    summary = A.shared_source_summary(A.shared_sources(left, right, check=False), left.count(), right.count())
    return summary.withColumn("share_of_smaller", F.round("share_of_smaller", 9))


@query("source_intersection", "U4", f"""
    SELECT sha256({KEY_OF('text')}) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    INTERSECT SELECT sha256({KEY_OF('text')}) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    docs = V.documents(spark, sf).select("doc_id", "text")
    covered = V.table(spark, sf, "labels").select("doc_id")
    return A.shared_keys(docs.join(covered, "doc_id", "left_semi"), docs.join(covered, "doc_id", "left_anti"), "text")


@query("overlap_excluded_rows", "F9", V.with_views(["aligned"], """
    SELECT sample_id, emotion_label FROM aligned WHERE sample_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def _(spark, sf):
    toxic = V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    return A.exclude_ids([V.aligned(spark, sf).select("sample_id", "emotion_label")], toxic)[0]


@query("corpus_union", "U3 F8", f"""
    SELECT corpus, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM (
        SELECT 'synthetic' AS corpus, trim(text) AS text FROM documents UNION ALL SELECT 'synthetic', trim(text) FROM conversations
        UNION ALL SELECT 'manual', trim(text) FROM benchmark) WHERE text <> '' GROUP BY corpus""")
def _(spark, sf):
    merged = A.union_corpora([("synthetic", V.table(spark, sf, "documents")), ("synthetic", V.table(spark, sf, "conversations")),
                              ("manual", V.table(spark, sf, "benchmark"))], "text")
    return merged.groupBy("corpus").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
