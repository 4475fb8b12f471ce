"""Alignment joins, label metrics and n-gram metrics over the gold/prediction views."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.registry import query
from narralytics.catalog.text_queries import tokens_13a_sql, tokens_alnum_sql
from narralytics.constants import EMOTION_LABELS
from narralytics.operators import align as A
from narralytics.operators import label_metrics as L
from narralytics.operators import overlap_metrics as O


@query("gold_prediction_aligned", "J1", V.with_views(["aligned"], """
    SELECT sample_id, emotion_label, predicted_emotion_label, length(reference_narrative) AS ref_chars,
           length(predicted_narrative) AS pred_chars FROM aligned"""))
def _(spark, sf):
    both = A.align(V.gold(spark, sf), V.pred(spark, sf)).aligned
    return both.select("sample_id", "emotion_label", "predicted_emotion_label",
                       F.length("reference_narrative").alias("ref_chars"), F.length("predicted_narrative").alias("pred_chars"))


@query("missing_predictions", "J2", V.with_views(["gold", "pred"], """
    SELECT sample_id, source_text, 'missing_prediction' AS status FROM gold
    WHERE sample_id NOT IN (SELECT sample_id FROM pred)"""))
def _(spark, sf):
    return A.missing_predictions(V.gold(spark, sf), V.pred(spark, sf)).select("sample_id", "source_text", "status")


@query("extra_predictions", "J3", V.with_views(["gold", "pred"], """
    SELECT sample_id, predicted_narrative, 'extra_prediction' AS status FROM pred
    WHERE sample_id NOT IN (SELECT sample_id FROM gold)"""))
def _(spark, sf):
    return A.extra_predictions(V.gold(spark, sf), V.pred(spark, sf)).select("sample_id", "predicted_narrative", "status")


@query("unaligned_rows_union", "U2", V.with_views(["gold", "pred"], """
    SELECT sample_id, source_text, NULL AS predicted_narrative, 'missing_prediction' AS status FROM gold
    WHERE sample_id NOT IN (SELECT sample_id FROM pred)
    UNION ALL SELECT sample_id, NULL, predicted_narrative, 'extra_prediction' FROM pred
    WHERE sample_id NOT IN (SELECT sample_id FROM gold)"""))
def _(spark, sf):
    return A.unaligned_rows(V.gold(spark, sf), V.pred(spark, sf)).select(
        "sample_id", "source_text", "predicted_narrative", "status")


@query("per_sample_metric_merge", "J4 A7", V.with_views(["gold", "aligned"], """
    SELECT g.sample_id, a.emotion_label = a.predicted_emotion_label AS emotion_correct,
           CASE WHEN a.sample_id IS NULL THEN NULL ELSE length(a.predicted_narrative) END AS pred_chars
    FROM gold g LEFT JOIN aligned a ON a.sample_id = g.sample_id"""))
def _(spark, sf):
    both = V.aligned(spark, sf)
    lengths = both.select("sample_id", F.length("predicted_narrative").alias("pred_chars"))
    merged = A.attach_metrics(V.gold(spark, sf), [L.correctness(both).select("sample_id", "emotion_correct"), None, lengths])
    return merged.select("sample_id", "emotion_correct", "pred_chars")


@query("per_sample_correctness", "A7", V.with_views(["aligned"], """
    SELECT sample_id, emotion_label, predicted_emotion_label, emotion_label = predicted_emotion_label AS emotion_correct FROM aligned"""))
def _(spark, sf):
    return L.correctness(V.aligned(spark, sf))


@query("label_accuracy", "A1", V.with_views(["aligned"], """
    SELECT round(avg(CASE WHEN emotion_label = predicted_emotion_label THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM aligned"""))
def _(spark, sf):
    return L.accuracy(V.aligned(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"), "n")


@query("confusion_long", "A2", V.with_views(["cells"], """
    SELECT g.label AS gold, p.label AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM (SELECT gold AS label FROM cells UNION SELECT pred FROM cells) g
    CROSS JOIN (SELECT gold AS label FROM cells UNION SELECT pred FROM cells) p
    LEFT JOIN cells c ON c.gold = g.label AND c.pred = p.label"""))
def _(spark, sf):
    return L.confusion_grid(L.cell_counts(V.aligned(spark, sf)))


MATRIX_LABELS = ["", *EMOTION_LABELS]


@query("confusion_wide", "A2 T13", V.with_views(["cells"], "SELECT gold, " + ", ".join(
    f"""CAST(coalesce(sum(CASE WHEN pred = '{x}' THEN n END), 0) AS BIGINT) AS "{x or 'empty_prediction'}" """
    for x in MATRIX_LABELS) + " FROM cells GROUP BY gold"))
def _(spark, sf):
    return L.confusion_matrix(L.cell_counts(V.aligned(spark, sf)), MATRIX_LABELS)


@query("label_precision_recall_f1", "A3", V.with_views(["label_scores"], """
    SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
           round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM label_scores"""))
def _(spark, sf):
    scores = L.label_scores(L.cell_counts(V.aligned(spark, sf)))
    return scores.select("label", "support", "predicted", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1_union", "A4", V.with_views(["label_scores"], "SELECT round(avg(f1), 9) AS macro_f1 FROM label_scores"))
def _(spark, sf):
    return L.macro_f1(L.cell_counts(V.aligned(spark, sf))).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("macro_f1_fixed", "A5", V.with_views(["label_scores"], f"""
    SELECT round(sum(f1) / 7.0, 9) AS macro_f1 FROM label_scores WHERE label IN {tuple(EMOTION_LABELS)}"""))
def _(spark, sf):
    return L.macro_f1(L.cell_counts(V.aligned(spark, sf)), "fixed").select(F.round("macro_f1", 9).alias("macro_f1"))


@query("macro_f1_complete_rows", "A6 T12", V.with_views(["aligned"], f"""
    , rows AS (SELECT emotion_label AS gold, predicted_emotion_label AS pred FROM aligned WHERE predicted_emotion_label <> ''),
    per AS (SELECT v.label, count(*) FILTER (WHERE gold = v.label AND pred = v.label) AS tp,
                   count(*) FILTER (WHERE gold <> v.label AND pred = v.label) AS fp,
                   count(*) FILTER (WHERE gold = v.label AND pred <> v.label) AS fn
            FROM rows, (SELECT unnest({V.LABEL_LIST_SQL}) AS label) v GROUP BY v.label)
    SELECT round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END) / 7.0, 9) AS macro_f1 FROM per"""))
def _(spark, sf):
    shouted = V.aligned(spark, sf).withColumn(
        "predicted_emotion_label", F.nullif(F.upper("predicted_emotion_label"), F.lit("")))
    cells = L.cell_counts(L.complete_rows(shouted))
    return L.macro_f1(cells, "fixed").select(F.round("macro_f1", 9).alias("macro_f1"))


@query("label_summary_long", "A1-A4 U1", V.with_views(["label_scores"], """
    , named AS (SELECT CASE WHEN label = '' THEN 'empty_prediction' ELSE label END AS name, "precision", recall, f1 FROM label_scores)
    SELECT 'accuracy' AS metric, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS value FROM cells
    UNION ALL SELECT 'macro_f1', round(avg(f1), 9) FROM label_scores
    UNION ALL SELECT name || '_precision', round("precision", 9) FROM named
    UNION ALL SELECT name || '_recall', round(recall, 9) FROM named
    UNION ALL SELECT name || '_f1', round(f1, 9) FROM named"""))
def _(spark, sf):
    return L.label_summary(L.cell_counts(V.aligned(spark, sf))).select("metric", F.round("value", 9).alias("value"))


@query("label_distribution_zero_filled", "A17", f"""
    SELECT CAST(i - 1 AS INTEGER) AS position, v AS label, count(d.doc_id) AS n
    FROM (SELECT unnest({V.LABEL_LIST_SQL}) AS v, unnest(range(1, 8)) AS i)
    LEFT JOIN (SELECT doc_id, {V.label_sql('doc_id')} AS label FROM documents) d ON d.label = v
    GROUP BY 1, 2""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select(V.pick_label(F.col("doc_id")).alias("label"))
    return L.label_distribution(docs, "label", EMOTION_LABELS)


@query("distinct_label_union", "U6", V.with_views(["aligned"], """
    SELECT emotion_label AS label FROM aligned UNION SELECT predicted_emotion_label FROM aligned"""))
def _(spark, sf):
    return A.label_union(V.aligned(spark, sf), "emotion_label", "predicted_emotion_label")


@query("unknown_labels", "U5 F7", V.with_views(["pred"], f"""
    SELECT predicted_emotion_label AS value FROM pred EXCEPT SELECT unnest({V.LABEL_LIST_SQL})"""))
def _(spark, sf):
    from narralytics.functions.labels import vocabulary
    return A.unknown_values(V.pred(spark, sf), "predicted_emotion_label", vocabulary(spark, EMOTION_LABELS))


@query("manual_review_sheet", "W3", V.with_views(["aligned"], """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY emotion_label ORDER BY sample_id) AS r FROM aligned)
    SELECT sample_id, source_text, reference_narrative, predicted_narrative, '' AS manual_relevance, '' AS manual_grammar, '' AS notes
    FROM (SELECT * FROM ranked WHERE r <= 7 ORDER BY emotion_label, sample_id LIMIT 50)"""))
def _(spark, sf):
    return A.manual_sheet(V.aligned(spark, sf), 50, 7)


# --- n-gram metrics --------------------------------------------------------------------------

def gram_sql(tokens: str, n: int) -> str:
    """Exploded n-grams of a list column as a subquery over ``toks``."""
    joined = " || ' ' || ".join(f"{tokens}[i + {j}]" for j in range(n))
    return f"SELECT sample_id, {joined} AS gram FROM (SELECT sample_id, {tokens}, unnest(range(1, len({tokens}) - {n - 2})) AS i FROM toks)"


def overlap_sql(hyp: str, ref: str, orders: tuple[int, ...]) -> str:
    """Clipped n-gram counts per sample, written as set algebra over exploded n-grams."""
    parts = []
    for n in orders:
        parts.append(f"""SELECT sample_id, {n} AS n, gram, sum(h) AS h, sum(r) AS r FROM (
            SELECT *, 1 AS h, 0 AS r FROM ({gram_sql('h', n)})
            UNION ALL SELECT *, 0, 1 FROM ({gram_sql('r', n)})) GROUP BY ALL""")
    cols = ", ".join(
        f"coalesce(sum(least(g.h, g.r)) FILTER (WHERE n = {n}), 0) AS m{n}, coalesce(sum(g.h) FILTER (WHERE n = {n}), 0) AS t{n}, "
        f"coalesce(sum(g.r) FILTER (WHERE n = {n}), 0) AS f{n}" for n in orders)
    return (f", toks AS (SELECT sample_id, {hyp} AS h, {ref} AS r FROM aligned), grams AS ({' UNION ALL '.join(parts)}), "
            f"stats AS (SELECT t.sample_id, {cols} FROM toks t LEFT JOIN grams g ON g.sample_id = t.sample_id GROUP BY t.sample_id)")


BLEU_SQL = overlap_sql(tokens_13a_sql("predicted_narrative"), tokens_13a_sql("reference_narrative"), (1, 2, 3, 4))
ROUGE_SQL = overlap_sql(tokens_alnum_sql("predicted_narrative"), tokens_alnum_sql("reference_narrative"), (1, 2))


def bleu_formula_sql(effective: bool) -> str:
    """Closed-form score over columns m1..m4, t1..t4, t1 = hyp length, f1 = ref length."""
    zeros = lambda k: " + ".join(f"(CASE WHEN m{j} = 0 AND t{j} > 0 THEN 1 ELSE 0 END)" for j in range(1, k + 1))
    logs = " + ".join(
        f"CASE WHEN t{k} = 0 THEN 0 WHEN m{k} = 0 THEN ln(100.0 / (power(2.0, {zeros(k)}) * t{k})) ELSE ln(100.0 * m{k} / t{k}) END"
        for k in range(1, 5))
    reached = " + ".join(f"(CASE WHEN t{k} > 0 THEN 1 ELSE 0 END)" for k in range(1, 5))
    bp = "CASE WHEN t1 >= f1 THEN 1.0 ELSE exp(1.0 - f1 / t1::DOUBLE) END"
    if effective:
        return f"CASE WHEN m1 + m2 + m3 + m4 = 0 OR t1 = 0 THEN 0.0 ELSE ({bp}) * exp(({logs}) / ({reached})) END"
    return f"CASE WHEN m1 + m2 + m3 + m4 = 0 OR t1 = 0 OR t4 = 0 THEN 0.0 ELSE ({bp}) * exp(({logs}) / 4.0) END"


SUMS_SQL = ", ".join(f"sum({c}{n}) AS {c}{n}" for n in range(1, 5) for c in "mtf")


@query("bleu_corpus_score", "A8 T20 T22", V.with_views(["aligned"], BLEU_SQL + f"""
    SELECT round({bleu_formula_sql(False)}, 6) AS bleu_corpus FROM (SELECT {SUMS_SQL} FROM stats)"""))
def _(spark, sf):
    return O.corpus_bleu(O.bleu_statistics(V.aligned(spark, sf))).select(F.round("bleu_corpus", 6).alias("bleu_corpus"))


@query("bleu_sentence_scores", "A9", V.with_views(["aligned"], BLEU_SQL + f"""
    SELECT sample_id, round({bleu_formula_sql(True)}, 6) AS bleu_sentence FROM stats"""))
def _(spark, sf):
    return O.sentence_bleu(O.bleu_statistics(V.aligned(spark, sf))).select(
        "sample_id", F.round("bleu_sentence", 6).alias("bleu_sentence"))


def rouge_select_sql() -> str:
    cols = []
    for n in (1, 2):
        p, r = f"(m{n} / greatest(t{n}, 1)::DOUBLE)", f"(m{n} / greatest(f{n}, 1)::DOUBLE)"
        cols += [f"round({p}, 6) AS rouge{n}_precision", f"round({r}, 6) AS rouge{n}_recall",
                 f"round(coalesce(2.0 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS rouge{n}_fmeasure"]
    return ", ".join(cols)


@query("rouge_n_scores", "A10 T21", V.with_views(["aligned"], ROUGE_SQL + f"SELECT sample_id, {rouge_select_sql()} FROM stats"))
def _(spark, sf):
    scores = O.rouge_n(V.aligned(spark, sf), stemmer=False)
    return scores.select("sample_id", *[F.round(c, 6).alias(c) for c in scores.columns if c != "sample_id"])


@query("rouge_n_stemmed_scores", "A10 T21")
def _(spark, sf):
    return O.rouge_n(V.aligned(spark, sf), stemmer=True)


@query("rouge_l_scores", "A11", V.with_views(["aligned"], f"""
    , t AS (SELECT sample_id, len({tokens_alnum_sql('predicted_narrative')}) AS h, len({tokens_alnum_sql('reference_narrative')}) AS r FROM aligned)
    SELECT sample_id, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "rougeL_precision", round(h / greatest(r, 1)::DOUBLE, 9) AS "rougeL_recall",
           round(CASE WHEN h > 0 THEN 2.0 * h / (h + r) ELSE 0 END::DOUBLE, 9) AS "rougeL_fmeasure" FROM t"""))
def _(spark, sf):
    """A prediction is its reference with words left out, so its tokens are the longest common subsequence."""
    scores = O.rouge_l(V.aligned(spark, sf), stemmer=False)
    return scores.select("sample_id", *[F.round(c, 9).alias(c) for c in scores.columns if c != "sample_id"])


@query("overlap_metric_means", "A12 U1", V.with_views(["aligned"], BLEU_SQL + f"""
    , r_toks AS (SELECT sample_id, {tokens_alnum_sql('predicted_narrative')} AS h, {tokens_alnum_sql('reference_narrative')} AS r FROM aligned),
    r_grams AS (SELECT sample_id, gram, sum(h) AS h, sum(r) AS r FROM (
        SELECT sample_id, unnest(h) AS gram, 1 AS h, 0 AS r FROM r_toks UNION ALL SELECT sample_id, unnest(r), 0, 1 FROM r_toks) GROUP BY ALL),
    r_stats AS (SELECT t.sample_id, coalesce(sum(least(g.h, g.r)), 0) AS m, coalesce(sum(g.h), 0) AS h, coalesce(sum(g.r), 0) AS r
        FROM r_toks t LEFT JOIN r_grams g ON g.sample_id = t.sample_id GROUP BY t.sample_id)
    SELECT 'bleu_corpus' AS metric, round({bleu_formula_sql(False)}, 6) AS value FROM (SELECT {SUMS_SQL} FROM stats)
    UNION ALL SELECT 'bleu_sentence_mean', round(avg({bleu_formula_sql(True)}), 6) FROM stats
    UNION ALL SELECT 'rouge1_mean', round(avg(coalesce(2.0 * m / nullif((h + r)::DOUBLE, 0), 0)), 6) FROM r_stats"""))
def _(spark, sf):
    both = V.aligned(spark, sf)
    stats = O.bleu_statistics(both).withColumn("bleu_sentence", O.bleu_score(effective_order=True))
    bleu = stats.agg(*O.sum_statistics(), F.avg("bleu_sentence").alias("sentence"))
    rouge = O.rouge_n(both, orders=(1,), stemmer=False).agg(F.avg("rouge1_fmeasure").alias("value"))
    parts: list[DataFrame] = [
        bleu.select(F.lit("bleu_corpus").alias("metric"), O.bleu_score().alias("value")),
        bleu.select(F.lit("bleu_sentence_mean").alias("metric"), F.col("sentence").alias("value")),
        rouge.select(F.lit("rouge1_mean").alias("metric"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts).select("metric", F.round("value", 6).alias("value"))
