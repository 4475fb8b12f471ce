"""Sources, sinks, run tables and streams, fed with tables that Spark writes from the driver tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.corpus_queries import FIRST, PAST, RATIO_SQL, STAND_IN_PRONOUNS
from narralytics.catalog.registry import query
from narralytics.catalog.stats_queries import RUNS_SQL, rounded, run_summaries
from narralytics.functions.plugins import RuleTagger
from narralytics.operators import runs as R
from narralytics.operators.ranking import top_per_group
from narralytics.constants import MAX_COMMENT_CHARS
from narralytics.operators.audits import file_fingerprints, order_free_print, ordered_print
from narralytics.session import scratch_path
from narralytics.operators.merkle import differing_ranges, merkle_tree
from narralytics.sources import runs as SR
from narralytics.sources import tables as S
from narralytics.streaming import early_stop, filters, telemetry


@query("csv_round_trip", "IO1 IO7", "SELECT doc_id, text, source FROM documents")
def _(spark, sf):
    path = S.write_csv(V.table(spark, sf, "documents").select("doc_id", "text", "source"), scratch_path(spark, "documents-csv"))
    return S.read_csv(spark, path, "doc_id long, text string, source string")


@query("gold_from_csv", "IO2", f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_id, {V.norm_sql('text')} AS source_text,
    {V.label_sql('doc_id')} AS emotion_label, {V.norm_sql('text')} AS reference_narrative FROM documents""")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select((F.col("doc_id") * 3).alias("line"), F.col("text").alias("source_text"),
                                                  V.pick_label(F.col("doc_id")).alias("emotion_label"), F.col("text").alias("reference_narrative"))
    return S.read_gold(spark, S.write_csv(rows, scratch_path(spark, "gold-csv")), "line")


@query("predictions_from_csv", "IO3", V.with_views(["pred"], "SELECT sample_id, predicted_narrative, predicted_emotion_label FROM pred"))
def _(spark, sf):
    rows = V.pred(spark, sf).withColumn("sample_id", F.concat(F.col("sample_id").cast("string"), F.lit(".0")))
    return S.read_predictions(spark, S.write_csv(rows, scratch_path(spark, "pred-csv")))


@query("comments_from_parquet", "IO4 T8", r"""SELECT doc_id, text FROM (SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 5000) AS text FROM documents)
    WHERE text <> '' AND text NOT IN ('[deleted]', '[removed]') ORDER BY doc_id LIMIT 12000""")
def _(spark, sf):
    return S.read_comments(spark, f"{sf}/documents.parquet", "doc_id", 12_000, MAX_COMMENT_CHARS)


@query("jsonl_round_trip", "IO5 IO6 F13", """SELECT 'sys' AS system, 'ins' AS instruction, text AS input, source AS output FROM documents""")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.lit("sys").alias("system"), F.lit("ins").alias("instruction"), F.col("text").alias("input"), F.col("source").alias("output"))
    return S.read_jsonl(spark, S.write_jsonl(rows, scratch_path(spark, "alpaca")), S.ALPACA_SCHEMA)


@query("nested_json_scan", "IO8", """SELECT source AS name, count(*) AS "count", string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE r <= 5) AS top_terms
    FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select("source", "doc_id")
    firsts = top_per_group(docs, ["source"], [F.col("doc_id")], 5).groupBy("source").agg(
        F.transform(F.sort_array(F.collect_list("doc_id")), lambda d: d.cast("string")).alias("top_terms"))
    nested = docs.groupBy("source").agg(F.count("*").alias("count")).join(firsts, "source")
    path = scratch_path(spark, "topics")
    nested.withColumnRenamed("source", "name").write.option("maxRecordsPerFile", 1).json(path)  # one document per file
    return S.read_nested(spark, path, S.TOPIC_SUMMARY_SCHEMA).select("name", "count", F.array_join("top_terms", ",").alias("top_terms"))


SUMMARY_SCHEMA = "rougeL_mean double, num_aligned_rows long, num_missing_prediction_rows long, gold_path string"


RUN_LAYOUT = "condition={condition}/seed=seed_{seed}/dataset={dataset}/run=run_{run_ts}/*.json"


def run_tree(spark, sf, **where) -> DataFrame:
    """Two stamped runs per key written as a tree; the older one lacks a row."""
    base = run_summaries(spark, sf).select("condition", F.col("seed"), "dataset", "rougeL_mean", "num_aligned_rows")
    runs = base.withColumn("r", F.explode(F.array(
        F.struct(F.lit("20260101_000000").alias("ts"), F.lit(0).alias("lost"), F.lit(0.0).alias("delta")),
        F.struct(F.lit("20260102_000000").alias("ts"), F.lit(1).alias("lost"), F.lit(1.0).alias("delta")))))
    rows = runs.select("condition", F.concat(F.lit("seed_"), F.col("seed")).alias("seed"), "dataset", F.concat(F.lit("run_"), F.col("r.ts")).alias("run"),
                       (F.col("rougeL_mean") + F.col("r.delta")).alias("rougeL_mean"), (F.col("num_aligned_rows") - F.col("r.lost")).alias("num_aligned_rows"),
                       F.col("r.lost").alias("num_missing_prediction_rows"), F.concat(F.lit("/data/"), "dataset", F.lit(".csv")).alias("gold_path"))
    path = scratch_path(spark, "runs")
    rows.write.partitionBy("condition", "seed", "dataset", "run").json(path)
    return SR.read_runs(spark, path, SUMMARY_SCHEMA, RUN_LAYOUT, **where)


RUN_SUMMARY_SQL = f"WITH {RUNS_SQL}, s AS (SELECT condition, seed::VARCHAR AS seed, dataset, avg(rougeL_mean) AS v, count(*) AS n FROM runs GROUP BY ALL)"


@query("latest_runs", "IO9", RUN_SUMMARY_SQL + " SELECT condition, seed, dataset, '20260102_000000' AS run_ts, round(v + 1, 9) AS rougeL_mean, n - 1 AS num_aligned_rows FROM s")
def _(spark, sf):
    return rounded(SR.latest_runs(run_tree(spark, sf)).select("condition", "seed", "dataset", "run_ts", "rougeL_mean", "num_aligned_rows"))


@query("latest_complete_runs", "IO10", RUN_SUMMARY_SQL + " SELECT condition, seed, dataset, '20260101_000000' AS run_ts, round(v, 9) AS rougeL_mean, n AS num_aligned_rows FROM s")
def _(spark, sf):
    gold = run_summaries(spark, sf).where("condition = 'single_joint' and seed = 42").select("dataset", F.col("num_aligned_rows").alias("gold_rows"))
    return rounded(SR.latest_complete_runs(run_tree(spark, sf), gold).select("condition", "seed", "dataset", "run_ts", "rougeL_mean", "num_aligned_rows"))


@query("runs_of_conditions", "IO9", RUN_SUMMARY_SQL + """ SELECT condition, seed, dataset, unnest(['20260101_000000', '20260102_000000']) AS run_ts FROM s
    WHERE condition IN ('paired_joint', 'single_narrative') AND seed = '2'""")
def _(spark, sf):
    """Only the folders of two conditions and one seed are listed and opened."""
    return run_tree(spark, sf, condition=["paired_joint", "single_narrative"], seed=["2"]).select("condition", "seed", "dataset", "run_ts")


@query("runs_on_dataset", "F10", RUN_SUMMARY_SQL + " SELECT condition, seed, ts AS run_ts FROM s, (SELECT unnest(['20260101_000000', '20260102_000000']) AS ts) WHERE dataset = 'stage1'")
def _(spark, sf):
    return SR.runs_on_dataset(run_tree(spark, sf), "stage1.csv").select("condition", "seed", "run_ts")


@query("text_fingerprints", "IO12", """SELECT lang, CAST(sum(('0x' || substr(md5(text), 1, 12))::BIGINT) AS VARCHAR) AS content_print,
    CAST(sum(('0x' || substr(md5(doc_id || ':' || text), 1, 12))::BIGINT) AS VARCHAR) AS ordered_print, min(sha256(text)) AS first_sha256 FROM documents GROUP BY lang""")
def _(spark, sf):
    return V.table(spark, sf, "documents").groupBy("lang").agg(
        order_free_print(F.col("text")).alias("content_print"), ordered_print(F.col("text"), F.col("doc_id")).alias("ordered_print"), F.min(F.sha2("text", 256)).alias("first_sha256"))


@query("merkle_ranges", "IO12", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS changed FROM documents),
    b AS (SELECT (r - 1) // 64 AS block, min(r) AS first_rank, max(r) AS last_rank, min(doc_id) AS first_key, max(doc_id) AS last_key FROM d GROUP BY 1 HAVING bool_or(changed))
    SELECT block, first_rank, last_rank, first_key AS first_key_a, last_key AS last_key_a, first_key AS first_key_b, last_key AS last_key_b FROM b""")
def _(spark, sf):
    """Blocks of documents that hold a changed text: those of toxic documents get one more character."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    toxic = V.table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit("!"))
    changed = docs.join(toxic, "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("toxic", F.lit(""))).alias("text"), "lang")
    return differing_ranges(spark, *(merkle_tree(t, "doc_id", leaf_rows=64, fan=8) for t in (docs, changed)))


@query("file_fingerprints", "IO12", """SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5(concat(doc_id, '|', text, '|', lang, '|', source, '|', n_chars)), 1, 12))::BIGINT) AS VARCHAR) AS content_print
    FROM documents""")
def _(spark, sf):
    return file_fingerprints(spark, f"{sf}/documents.parquet").select("rows", "content_print")


# --- run artefacts ---------------------------------------------------------------------------
HISTORY_SQL = """entries AS (SELECT user_id AS run, event_id AS checkpoint, day(ts) AS step, 1 + value / 1000 AS eval_loss FROM events),
    history AS (SELECT run, CAST(step AS BIGINT) AS step, arg_max(eval_loss, checkpoint) AS eval_loss FROM entries GROUP BY ALL)"""


def history(spark, sf) -> DataFrame:
    entries = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("checkpoint"),
                                                  F.dayofmonth("ts").cast("long").alias("step"), (1 + F.col("value") / 1000).alias("eval_loss"))
    return R.last_per_step(entries)


@query("validation_history", "W6", f"WITH {HISTORY_SQL} SELECT run, step, round(eval_loss, 9) AS eval_loss FROM history")
def _(spark, sf):
    return rounded(history(spark, sf))


@query("validation_history_nested", "W6 IO8", f"WITH {HISTORY_SQL} SELECT run, step, round(eval_loss, 9) AS eval_loss FROM history")
def _(spark, sf):
    """The same history from trainer-state documents: one nested log per run and checkpoint day."""
    rows = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("checkpoint"), F.struct(
        F.dayofmonth("ts").cast("long").alias("step"), (1 + F.col("value") / 1000).alias("eval_loss"), F.lit(1.0).alias("epoch")).alias("e"))
    states = rows.select("run", "checkpoint", F.array("e").alias("log_history"))
    path = S.write_jsonl(states, scratch_path(spark, "states"))
    return rounded(R.validation_history(spark.read.schema(f"run long, checkpoint long, {S.TRAINER_STATE_SCHEMA}").json(path)))


STOP_SQL = f"""WITH {HISTORY_SQL}, b AS (SELECT run, arg_min(step, (eval_loss, step)) AS best_step, min(eval_loss) AS best_loss,
    max(step) AS latest_step, arg_max(eval_loss, step) AS latest_loss FROM history GROUP BY run),
    d AS (SELECT b.*, (SELECT count(*) FROM history h WHERE h.run = b.run AND h.step > b.best_step) AS later, latest_loss / best_loss - 1 AS rel FROM b)
    SELECT run, best_step, latest_step, later AS validations_without_improvement, round(rel, 9) AS relative_degradation,
           CASE WHEN latest_step <> best_step AND rel >= 0.1 THEN 'immediate_relative_degradation_threshold' WHEN later >= 2 THEN 'validation_patience_exhausted' END AS reason FROM d"""


@query("early_stop_decisions", "W7", STOP_SQL)
def _(spark, sf):
    return rounded(R.early_stop(history(spark, sf)).select("run", "best_step", "latest_step", "validations_without_improvement", "relative_degradation", "reason"))


@query("early_stop_streamed", "W6 W7 ST2", STOP_SQL)
def _(spark, sf):
    """The same decisions from a stream of the validations, two files a micro-batch."""
    source, out, checkpoint = (scratch_path(spark, f"stop-{x}") for x in ("in", "out", "checkpoint"))
    history(spark, sf).repartition(4, "step").write.parquet(source)
    stream = spark.readStream.schema("run long, step long, eval_loss double").option("maxFilesPerTrigger", 2).parquet(source)
    early_stop.stop_stream(stream, out, checkpoint).start().awaitTermination()
    found = early_stop.latest_decisions(spark.read.parquet(out))
    return rounded(found.select("run", "best_step", "latest_step", "validations_without_improvement", "relative_degradation", "reason"))


FILES_SQL = "files AS (SELECT DISTINCT user_id AS run, day(ts)::BIGINT AS step FROM events WHERE event_type <> 'error')"


def files(spark, sf) -> DataFrame:
    return V.table(spark, sf, "events").where("event_type <> 'error'").select(F.col("user_id").alias("run"), F.dayofmonth("ts").cast("long").alias("step"))


@query("available_checkpoints", "J13", f"WITH {HISTORY_SQL}, {FILES_SQL} SELECT h.run, h.step FROM history h WHERE EXISTS (SELECT 1 FROM files f WHERE f.run = h.run AND f.step = h.step)")
def _(spark, sf):
    return R.available_checkpoints(history(spark, sf), files(spark, sf)).select("run", "step")


@query("selected_checkpoints", "W8 J13", f"""WITH {HISTORY_SQL}, {FILES_SQL}, k AS (SELECT h.* FROM history h JOIN files f ON f.run = h.run AND f.step = h.step)
    SELECT run, arg_min(step, (eval_loss, step)) AS selected_step, round(min(eval_loss), 9) AS selected_loss FROM k GROUP BY run""")
def _(spark, sf):
    return rounded(R.select_checkpoint(R.available_checkpoints(history(spark, sf), files(spark, sf))))


@query("training_join", "J11", """SELECT 'model_' || c_custkey AS model_path, c_mktsegment AS condition, 3.0::DOUBLE AS epoch, 1959::BIGINT AS global_step,
    count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _(spark, sf):
    path = F.concat(F.lit("model_"), F.col("c_custkey").cast("string"))
    customers = V.table(spark, sf, "customer")
    manifest = customers.select(path.alias("model_path"), F.col("c_mktsegment").alias("condition"))
    counts = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    results = customers.select("c_custkey", path.alias("model_path")).join(counts, "c_custkey", "left").select(
        "model_path", F.lit(3.0).alias("epoch"), F.lit(1959).cast("long").alias("global_step"), F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))
    return R.join_training(manifest, results, 2.99, 1959)


@query("job_status_rollup", "A36", """SELECT CAST(i - 1 AS INTEGER) AS position, s AS status, (SELECT count(*) FROM events e
    WHERE CASE e.event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE e.event_type END = s) AS n
    FROM (SELECT unnest(['pending', 'running', 'completed', 'failed']) AS s, unnest(range(1, 5)) AS i)""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return R.job_status(V.table(spark, sf, "events").select(status.alias("status")))


@query("weighted_losses", "A37", """WITH t AS (SELECT user_id AS run, avg(value) FILTER (WHERE event_type IN ('view', 'click')) AS l, avg(value) FILTER (WHERE event_type NOT IN ('view', 'click')) AS n FROM events GROUP BY 1)
    SELECT run, round(l, 9) AS label_loss, round(n, 9) AS narrative_loss, round((0.8 * l + n) / 1.8, 9) AS weighted_loss FROM t""")
def _(spark, sf):
    task = F.when(F.col("event_type").isin("view", "click"), "label").otherwise("narrative")
    return rounded(R.weighted_loss(V.table(spark, sf, "events").select(F.col("user_id").alias("run"), task.alias("task"), F.col("value").alias("loss")), 0.8))


@query("sorted_predictions", "S4", V.with_views(["pred"], "SELECT sample_id, predicted_emotion_label FROM pred"))
def _(spark, sf):
    return V.pred(spark, sf).select("sample_id", "predicted_emotion_label").orderBy("sample_id")


# --- telemetry -------------------------------------------------------------------------------

def records(events: DataFrame) -> DataFrame:
    """One telemetry record with two devices per event."""
    device = lambda shift: F.struct((F.floor("value") + shift).cast("double").alias("utilization_percent"), F.col("value").alias("power_w"),
                                    (F.floor(F.col("value") / 5) + shift).cast("long").alias("temperature_c"))
    phase = F.when(F.col("event_type").isin("click", "view"), "training").when(F.col("event_type") == "purchase", "evaluation").otherwise("idle")
    return events.select(F.col("ts").cast("timestamp").alias("timestamp"), phase.alias("phase"), F.array(device(0), device(7)).alias("gpus"))


GPU_SQL = """g AS (SELECT ts, CASE WHEN event_type IN ('click', 'view') THEN 'training' WHEN event_type = 'purchase' THEN 'evaluation' ELSE 'idle' END AS phase,
    floor(value) + s AS u, value AS p, CAST(floor(value / 5) + s AS BIGINT) AS t, s FROM events, (SELECT unnest([0, 7]) AS s))"""
GPU_COLUMNS_SQL = """count(*) FILTER (WHERE s = 0) AS samples, count(*) AS observations, round(avg(u), 6) AS mean_utilization, count(*) FILTER (WHERE u >= 90) AS busy_observations,
    round(avg(CASE WHEN u >= 90 THEN 1.0 ELSE 0 END), 6) AS busy_share, round(avg(p), 6) AS mean_power_w, max(t) AS maximum_temperature_c"""


@query("telemetry_rollup", "A35", f"WITH {GPU_SQL} SELECT phase, {GPU_COLUMNS_SQL} FROM g GROUP BY phase")
def _(spark, sf):
    return rounded(R.telemetry_rollup(records(V.table(spark, sf, "events"))), 6)


PHASE_SQL = """p AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS running, user_id % 2 = 0 AS busy FROM events)"""


@query("telemetry_phases", "A35", f"""WITH {PHASE_SQL} SELECT phase, count(*) AS records FROM (
    SELECT 'training' AS phase FROM p WHERE running > 0 UNION ALL SELECT 'evaluation' FROM p WHERE busy) GROUP BY phase""")
def _(spark, sf):
    running = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("training_running")
    phase = F.when(F.col("user_id") % 2 == 0, "evaluating").otherwise("idle").alias("evaluation_phase")
    return R.with_phases(V.table(spark, sf, "events").select(running, phase)).groupBy("phase").agg(F.count("*").alias("records"))


@query("telemetry_windows_streamed", "ST2 A35", f"WITH {GPU_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, phase, {GPU_COLUMNS_SQL} FROM g GROUP BY 1, 2")
def _(spark, sf):
    stream = V.table_stream(spark, sf, "events")
    out = scratch_path(spark, "telemetry")
    telemetry.rollup_stream(records(stream), f"{out}/rows", f"{out}/checkpoint").start().awaitTermination()
    final = telemetry.latest_windows(spark.read.parquet(f"{out}/rows"))
    return rounded(final.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), 6)


@query("narrative_filter_streamed", "ST1 F4", f"WITH {RATIO_SQL} SELECT doc_id, word_count FROM ratios WHERE past_verb_ratio > {PAST} AND first_person_ratio > {FIRST}")
def _(spark, sf):
    stream = V.table_stream(spark, sf, "documents", maxFilesPerTrigger=1).select("doc_id", "text")
    out = scratch_path(spark, "narratives")
    filters.filter_stream(stream, out, f"{out}/checkpoint", "doc_id", tagger=RuleTagger(STAND_IN_PRONOUNS)).start().awaitTermination()
    return spark.read.parquet(f"{out}/kept").select("doc_id", "word_count")
