"""The three end-to-end flows over the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.registry import query
from narralytics.catalog.stats_queries import METRICS, RUNS_SQL, _sign, contrast_sql, rounded, run_summaries, runs
from narralytics.operators.topics import policy_codebook
from narralytics.plans.corpus_topics import study_topics
from narralytics.plans.evaluation import evaluate, row_counts
from narralytics.plans.multiseed import compare_conditions


@query("evaluation_run", "J1-J4 A1-A12 U1 IO11")
def _(spark, sf):
    return rounded(evaluate(V.gold(spark, sf), V.pred(spark, sf)).summary, 6)


@query("alignment_counts", "J1 J2 J3", V.with_views(["gold", "pred"], """
    SELECT 'num_gold_rows' AS metric, count(*)::DOUBLE AS value FROM gold UNION ALL SELECT 'num_prediction_rows', count(*)::DOUBLE FROM pred
    UNION ALL SELECT 'num_aligned_rows', count(*)::DOUBLE FROM gold WHERE sample_id IN (SELECT sample_id FROM pred)
    UNION ALL SELECT 'num_missing_prediction_rows', count(*)::DOUBLE FROM gold WHERE sample_id NOT IN (SELECT sample_id FROM pred)"""))
def _(spark, sf):
    return row_counts(V.gold(spark, sf), V.pred(spark, sf))


@query("topic_study", "V6 V8-V11 V1 S1")
def _(spark, sf):
    study = study_topics(V.documents(spark, sf).select("doc_id", "text"), "doc_id", policy_codebook(spark), clusters=8, min_size=20, min_topics=2)
    return study.review


CONTROLS = ["paired_narrative", "single_joint", "single_narrative"]
CONTROL_IDS = {f"v{i}": {"metric": m, "contrast": c} for i, (m, c) in enumerate((m, c) for m in METRICS for c in CONTROLS)}


def control_columns_sql() -> str:
    value = lambda m, c: f"max({m}) FILTER (WHERE condition = '{c}')"
    return ", ".join(f"{_sign(t['metric'])} * ({value(t['metric'], 'paired_joint')} - {value(t['metric'], t['contrast'])}) AS {v}" for v, t in CONTROL_IDS.items())


@query("multiseed_comparison", "R13 A29 R7 R8 W5 R5 R14", "SELECT * EXCLUDE (significant_95), CASE WHEN ci_95_low > 0 THEN 'treatment' "
       "WHEN ci_95_high < 0 THEN 'control' ELSE 'no_clear_difference' END AS favored FROM (" + contrast_sql(
           f"WITH {RUNS_SQL}, vals AS (SELECT dataset, seed, sample_id, {control_columns_sql()} FROM runs GROUP BY dataset, seed, sample_id)",
           CONTROL_IDS, 200, 20260819, 6) + ")")
def _(spark, sf):
    result = compare_conditions(run_summaries(spark, sf), runs(spark, sf), "paired_joint", CONTROLS,
                                METRICS, METRICS, ["rougeL_mean", "bertscore_f1_mean"], samples=200, portable=True)
    return result.hierarchical.select("dataset", "metric", "contrast", *[F.round(c, 6).alias(c) for c in ("effect", "ci_95_low", "ci_95_high", "p_value")], "favored")
