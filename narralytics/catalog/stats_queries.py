"""Seed statistics, tests and bootstraps over run tables derived from documents and labels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.alignment_queries import bleu_formula_sql, overlap_sql
from narralytics.catalog.registry import query
from narralytics.catalog.text_queries import tokens_13a_sql, tokens_alnum_sql
from narralytics.constants import PER_SAMPLE_METRICS
from narralytics.operators import align as A
from narralytics.operators import overlap_metrics as O
from narralytics.operators import resample as R
from narralytics.operators import stats as S
from narralytics.session import with_once

CONDITIONS = ["single_narrative", "single_joint", "paired_narrative", "paired_joint"]
SEEDS = [42, 1, 2]
METRICS = list(PER_SAMPLE_METRICS)
CONTRASTS = {
    "paired_minus_single_under_narrative": {"paired_narrative": 1, "single_narrative": -1},
    "paired_minus_single_under_joint": {"paired_joint": 1, "single_joint": -1},
    "joint_minus_narrative_for_single": {"single_joint": 1, "single_narrative": -1},
    "joint_minus_narrative_for_paired": {"paired_joint": 1, "paired_narrative": -1},
    "interaction": {"paired_joint": 1, "paired_narrative": -1, "single_joint": -1, "single_narrative": 1},
}
SCORE = "((d.n_chars * {a} + d.doc_id * 7 + s.seed * 17 + c.position * {b}) % 1000)"
RUNS_SQL = f"""runs AS (
    SELECT CASE WHEN l.doc_id IS NULL THEN 'stage1' ELSE 'manual' END AS dataset, c.condition, s.seed, d.doc_id AS sample_id,
           {", ".join(f"{SCORE.format(a=31 + 2 * i, b=13 * (i + 1))} / 1000::DOUBLE AS {m}" for i, m in enumerate(METRICS))}
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    CROSS JOIN (SELECT unnest({CONDITIONS}) AS condition, unnest(range(1, 5)) AS position) c
    CROSS JOIN (SELECT unnest({SEEDS}) AS seed) s)"""
SEED_SQL = RUNS_SQL + ", seed_metrics AS (" + " UNION ALL ".join(
    f"SELECT dataset, condition, seed, '{m}' AS metric, avg({m}) AS value FROM runs GROUP BY dataset, condition, seed" for m in METRICS) + ")"
SIGN_SQL = "CASE WHEN metric = 'normalized_dtw_distance_mean' THEN -1.0 ELSE 1.0 END"


def _dataset(spark, sf) -> DataFrame:
    covered = V.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("covered"))
    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars").join(covered, "doc_id", "left")
    return docs.withColumn("dataset", F.when(F.col("covered"), "manual").otherwise("stage1"))


def runs(spark, sf) -> DataFrame:
    conditions = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(i).alias("position")) for i, c in enumerate(CONDITIONS, 1)]))
    base = _dataset(spark, sf).withColumn("c", conditions).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    score = lambda a, b: F.pmod(F.col("n_chars") * a + F.col("doc_id") * 7 + F.col("seed") * 17 + F.col("c.position") * b, F.lit(1000)) / 1000.0
    return base.select("dataset", "c.condition", "seed", F.col("doc_id").alias("sample_id"),
                       *[score(31 + 2 * i, 13 * (i + 1)).alias(m) for i, m in enumerate(METRICS)])


def run_summaries(spark, sf) -> DataFrame:
    """Wide run table: one row per (dataset, condition, seed)."""
    return runs(spark, sf).groupBy("dataset", "condition", "seed").agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("num_aligned_rows"), F.lit(0).alias("num_missing_prediction_rows"))


def seed_metrics(spark, sf) -> DataFrame:
    return S.seed_metrics(run_summaries(spark, sf), METRICS)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@query("seed_metric_table", "R13", f"WITH {SEED_SQL} SELECT dataset, condition, CAST(seed AS INTEGER) AS seed, metric, round(value, 9) AS value FROM seed_metrics")
def _(spark, sf):
    return rounded(seed_metrics(spark, sf))


SUMMARY_SQL = "summary AS (SELECT dataset, condition, metric, count(*) AS n_seeds, avg(value) AS mean, stddev_samp(value) AS sd FROM seed_metrics GROUP BY ALL)"


@query("condition_summary", "A28", f"WITH {SEED_SQL}, {SUMMARY_SQL} SELECT dataset, condition, metric, n_seeds, round(mean, 9) AS mean, round(sd, 9) AS sd FROM summary")
def _(spark, sf):
    return rounded(S.condition_summary(seed_metrics(spark, sf)))


@query("condition_intervals", "A29", f"""WITH {SEED_SQL}, {SUMMARY_SQL}
    SELECT dataset, condition, metric, n_seeds, round(mean, 8) AS mean, round(sd, 8) AS sd,
           round(mean - 4.302652729696142 * sd / sqrt(3.0), 8) AS ci_95_low, round(mean + 4.302652729696142 * sd / sqrt(3.0), 8) AS ci_95_high FROM summary""")
def _(spark, sf):
    return rounded(S.with_t_interval(S.condition_summary(seed_metrics(spark, sf))), 8)


PAIR_SQL = f"""adv AS (SELECT t.dataset, t.metric, c.condition AS control, t.seed, t.value AS tv, c.value AS cv,
    (CASE WHEN t.metric = 'normalized_dtw_distance_mean' THEN -1.0 ELSE 1.0 END) * (t.value - c.value) AS a
    FROM seed_metrics t JOIN seed_metrics c ON c.dataset = t.dataset AND c.metric = t.metric AND c.seed = t.seed
    WHERE t.condition = 'paired_joint' AND c.condition <> 'paired_joint')"""
ADV_SQL = PAIR_SQL + """,
    tests AS (SELECT dataset, metric, control, count(*) AS n_seeds, avg(tv) AS treatment_mean, avg(cv) AS control_mean, avg(a) AS m, CASE WHEN stddev_samp(a) < 1e-12 THEN 0 ELSE stddev_samp(a) END AS s,
        list(a ORDER BY a) AS v FROM adv GROUP BY ALL),
    flips AS (SELECT dataset, metric, control, avg(CASE WHEN abs((v[1] * b1 + v[2] * b2 + v[3] * b3) / 3) >= abs(m) - 1e-15 THEN 1.0 ELSE 0 END) AS p
        FROM tests, (SELECT unnest([-1, 1]) AS b1), (SELECT unnest([-1, 1]) AS b2), (SELECT unnest([-1, 1]) AS b3) GROUP BY ALL),
    tp AS (SELECT *, CASE WHEN s > 0 THEN 2 * (1 - (0.5 + abs(m / (s / sqrt(3.0))) / (2 * sqrt(2 + power(m / (s / sqrt(3.0)), 2))))) WHEN abs(m) > 1e-12 THEN 0.0 END AS tp FROM tests)"""


def advantages(spark, sf) -> DataFrame:
    """Advantage of the treatment over each of the three controls, per seed."""
    metrics = seed_metrics(spark, sf)
    treated = metrics.where("condition = 'paired_joint'").select("dataset", "metric", "seed", F.col("value").alias("treatment"))
    controls = metrics.where("condition <> 'paired_joint'").select("dataset", "metric", "seed", F.col("condition").alias("control_name"), F.col("value").alias("control"))
    return treated.join(controls, ["dataset", "metric", "seed"]).withColumn(
        "advantage", S.direction(F.col("metric")) * (F.col("treatment") - F.col("control")))


@query("paired_seed_tests", "R7 R8 R9", f"""WITH {SEED_SQL}, {ADV_SQL}
    SELECT tp.dataset, tp.metric, tp.control AS control_name, n_seeds, round(treatment_mean, 8) AS treatment_mean, round(control_mean, 8) AS control_mean,
           round(m, 8) AS mean_advantage, round(m - 4.302652729696142 * s / sqrt(3.0), 8) AS advantage_ci_95_low,
           round(m + 4.302652729696142 * s / sqrt(3.0), 8) AS advantage_ci_95_high, round(m / nullif(s, 0), 6) AS cohen_dz,
           round(tp, 8) AS paired_t_p, round(f.p, 8) AS exact_sign_flip_p
    FROM tp JOIN flips f ON f.dataset = tp.dataset AND f.metric = tp.metric AND f.control = tp.control""")
def _(spark, sf):
    tests = S.paired_tests(advantages(spark, sf), ["dataset", "metric", "control_name"])
    return rounded(tests.withColumn("cohen_dz", F.round("cohen_dz", 6)), 8)


@query("sign_flip_of_nations", "R8", """
    WITH RECURSIVE v AS (SELECT c_mktsegment AS segment, c_nationkey AS seed, round(100 * avg(c_acctbal)) AS t FROM customer GROUP BY ALL),
    u AS (SELECT c_nationkey AS seed, round(100 * avg(c_acctbal)) AS c FROM customer GROUP BY ALL),
    a AS MATERIALIZED (SELECT segment, t - c AS a, row_number() OVER (PARTITION BY segment ORDER BY v.seed) AS i, count(*) OVER (PARTITION BY segment) AS k FROM v JOIN u ON u.seed = v.seed),
    f AS (SELECT segment, 0::BIGINT AS i, 0::DOUBLE AS s FROM (SELECT DISTINCT segment FROM a) UNION ALL
          SELECT f.segment, a.i, f.s + g * a.a FROM f JOIN a ON a.segment = f.segment AND a.i = f.i + 1 AND a.i <= a.k // 2, (SELECT unnest([-1, 1]) AS g)),
    b AS (SELECT segment, (SELECT max(k // 2) FROM a WHERE a.segment = d.segment) AS i, 0::DOUBLE AS s FROM (SELECT DISTINCT segment FROM a) d UNION ALL
          SELECT b.segment, a.i, b.s + g * a.a FROM b JOIN a ON a.segment = b.segment AND a.i = b.i + 1, (SELECT unnest([-1, 1]) AS g)),
    m AS (SELECT segment, max(k) AS k, abs(sum(a)) AS observed FROM a GROUP BY segment),
    l AS MATERIALIZED (SELECT f.segment, s, count(*) AS n FROM f JOIN m ON m.segment = f.segment AND f.i = m.k // 2 GROUP BY ALL),
    r AS MATERIALIZED (SELECT b.segment, s, count(*) AS n FROM b JOIN m ON m.segment = b.segment AND b.i = m.k GROUP BY ALL)
    SELECT l.segment, any_value(m.k) AS n_seeds, round(sum(CASE WHEN abs(l.s + r.s) >= m.observed THEN l.n * r.n ELSE 0 END) / power(2, any_value(m.k)), 9) AS exact_sign_flip_p
    FROM l JOIN r ON r.segment = l.segment JOIN m ON m.segment = l.segment GROUP BY l.segment""")
def _(spark, sf):
    """Nations as seeds: mean balance of a segment's customers against that of all, in cents."""
    customers = V.table(spark, sf, "customer")
    mean = F.round(100 * F.avg("c_acctbal"))
    every = customers.groupBy(F.col("c_nationkey").alias("seed")).agg(mean.alias("control"))
    pairs = customers.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("seed")).agg(mean.alias("treatment")).join(every, "seed")
    tests = S.paired_tests(pairs.withColumn("advantage", F.col("treatment") - F.col("control")), ["segment"])
    return tests.select("segment", "n_seeds", F.round("exact_sign_flip_p", 9).alias("exact_sign_flip_p"))


@query("seed_pair_comparison", "R7 R9", f"""WITH {RUNS_SQL}, m AS MATERIALIZED (SELECT dataset, condition, seed, {', '.join(f'avg({x}) AS {x}' for x in METRICS)}
        FROM runs WHERE condition IN ('paired_joint', 'single_narrative') GROUP BY dataset, condition, seed),
    l AS (UNPIVOT m ON {', '.join(METRICS)} INTO NAME metric VALUE value)
    SELECT t.dataset, t.metric, CAST(t.seed AS INTEGER) AS seed, round(t.value, 9) AS treatment, round(c.value, 9) AS control,
           round((CASE WHEN t.metric = 'normalized_dtw_distance_mean' THEN -1.0 ELSE 1.0 END) * (t.value - c.value), 9) AS advantage
    FROM l t JOIN l c ON c.dataset = t.dataset AND c.metric = t.metric AND c.seed = t.seed WHERE t.condition = 'paired_joint' AND c.condition = 'single_narrative'""")
def _(spark, sf):
    return rounded(S.seed_advantages(seed_metrics(spark, sf), "paired_joint", "single_narrative")).select(
        "dataset", "metric", "seed", "treatment", "control", "advantage")


@query("holm_adjusted_tests", "W5", f"""WITH {SEED_SQL}, {ADV_SQL},
    r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY dataset, metric) AS k FROM tp WINDOW w AS (PARTITION BY dataset, metric ORDER BY tp, control))
    SELECT dataset, metric, control AS control_name, round(tp, 8) AS paired_t_p,
           round(max(least(1.0, (k - r + 1) * tp)) OVER (PARTITION BY dataset, metric ORDER BY r), 8) AS p_holm FROM r""")
def _(spark, sf):
    tests = S.paired_tests(advantages(spark, sf), ["dataset", "metric", "control_name"])
    return rounded(S.holm(tests, ["dataset", "metric"], "paired_t_p", "control_name"), 8).select("dataset", "metric", "control_name", "paired_t_p", "p_holm")


@query("two_system_comparison", "R10 R9", f"""WITH {SEED_SQL}, w AS (SELECT dataset, metric, avg(value) FILTER (WHERE condition = 'single_narrative') AS b,
    avg(value) FILTER (WHERE condition = 'paired_joint') AS c FROM seed_metrics GROUP BY ALL)
    SELECT dataset, metric, round(b, 9) AS baseline_value, round(c, 9) AS candidate_value, metric <> 'normalized_dtw_distance_mean' AS higher_is_better,
           round({SIGN_SQL} * (c - b), 9) AS improvement FROM w""")
def _(spark, sf):
    return rounded(S.compare_two(_means(spark, sf), "single_narrative", "paired_joint"))


def _means(spark, sf) -> DataFrame:
    return S.condition_summary(seed_metrics(spark, sf)).select("dataset", "condition", "metric", F.col("mean").alias("value"))


@query("improvement_tally", "R15", f"""WITH {SEED_SQL}, w AS (SELECT dataset, metric, {SIGN_SQL} * (avg(value) FILTER (WHERE condition = 'paired_joint')
    - avg(value) FILTER (WHERE condition = 'single_narrative')) AS i FROM seed_metrics GROUP BY dataset, metric)
    SELECT count(*) FILTER (WHERE i > 0) AS improved, count(*) FILTER (WHERE abs(i) < 1e-12) AS tied, count(*) AS comparisons FROM w""")
def _(spark, sf):
    return S.tally(S.compare_two(_means(spark, sf), "single_narrative", "paired_joint"))


BEST_SQL = f"""m AS (SELECT dataset, condition, metric, avg(value) AS value FROM seed_metrics GROUP BY ALL),
    best AS (SELECT dataset, metric, condition AS best_setting, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, metric
        ORDER BY -({SIGN_SQL}) * value, list_position({CONDITIONS[1:]}, condition)) AS r FROM m WHERE condition <> 'single_narrative') WHERE r = 1)"""


@query("best_setting", "W9", f"WITH {SEED_SQL}, {BEST_SQL} SELECT dataset, metric, best_setting, round(best_value, 9) AS best_value FROM best")
def _(spark, sf):
    return rounded(S.best_setting(_means(spark, sf), {c: i for i, c in enumerate(CONDITIONS[1:])}))


@query("multi_setting_comparison", "R11 W9", f"""WITH {SEED_SQL}, {BEST_SQL}, n AS (SELECT condition, count(*) AS rows FROM runs GROUP BY condition)
    SELECT b.best_setting, m.dataset, m.metric, round(max(value) FILTER (WHERE m.condition = 'single_narrative'), 9) AS baseline_value,
           {", ".join(f"round(max(value) FILTER (WHERE m.condition = '{c}'), 9) AS {c}" for c in CONDITIONS[1:])},
           round(max(b.best_value), 9) AS best_value, max(n.rows) AS rows
    FROM m JOIN best b ON b.dataset = m.dataset AND b.metric = m.metric JOIN n ON n.condition = b.best_setting GROUP BY b.best_setting, m.dataset, m.metric""")
def _(spark, sf):
    training = runs(spark, sf).groupBy("condition").agg(F.count("*").alias("rows"))
    return rounded(S.compare_settings(_means(spark, sf), "single_narrative", CONDITIONS[1:], training))


@query("run_comparison_wide", "R12", f"""WITH {SEED_SQL} SELECT dataset, condition, CAST(seed AS INTEGER) AS seed,
    {", ".join(f"round(max(value) FILTER (WHERE metric = '{m}'), 9) AS {m}" for m in METRICS)} FROM seed_metrics GROUP BY dataset, condition, seed""")
def _(spark, sf):
    return rounded(S.run_table(seed_metrics(spark, sf), METRICS))


@query("formatted_mean_sd", "R16", f"""WITH {SEED_SQL}, {SUMMARY_SQL} SELECT dataset, condition,
    {", ".join(f"max(printf('%.5f +/- %.5f', mean, sd)) FILTER (WHERE metric = '{m}') AS {m}" for m in METRICS)} FROM summary GROUP BY dataset, condition""")
def _(spark, sf):
    return S.formatted_summary(S.condition_summary(seed_metrics(spark, sf)), METRICS)


@query("condition_pivot_alignment", "J6", f"""WITH {RUNS_SQL} SELECT dataset, CAST(seed AS INTEGER) AS seed, sample_id,
    {", ".join(f"max(rougeL_mean) FILTER (WHERE condition = '{c}') AS {c}" for c in CONDITIONS)} FROM runs GROUP BY dataset, seed, sample_id""")
def _(spark, sf):
    scores = runs(spark, sf).select("dataset", "condition", "seed", "sample_id", F.col("rougeL_mean").alias("value"))
    return A.pivot_conditions(scores, CONDITIONS, ["dataset", "seed", "sample_id"])


# --- resampling ------------------------------------------------------------------------------
SAMPLES = 100
DRAW = "('0x' || substr(md5(concat_ws(':', {keys})), 1, 8))::BIGINT % n"
CONTRAST_COLUMNS = {(m, c): " + ".join(f"({w}) * max({m}) FILTER (WHERE condition = '{k}')" for k, w in weights.items())
                    for m in METRICS for c, weights in CONTRASTS.items()}


def contrast_sql(select: str, ids: dict[str, dict[str, str]], samples: int = 100, seed: int = 20260824, digits: int = 8) -> str:
    """Hierarchical bootstrap in SQL: rows within (dataset, seed), then seeds within dataset."""
    names = list(ids)
    longs = " UNION ALL ".join(
        "SELECT dataset, b, " + ", ".join(f"'{v}' AS {k}" for k, v in tags.items()) + f", {n} AS value FROM {{0}}" for n, tags in ids.items())
    by = ", ".join(next(iter(ids.values())))
    return f"""{select},
    idx AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY sample_id) - 1 AS idx FROM vals),
    sizes AS (SELECT dataset, seed, count(*) AS n FROM vals GROUP BY ALL),
    reps AS (SELECT dataset, seed, n, unnest(range(0, {samples})) AS b FROM sizes),
    slots AS (SELECT dataset, seed, n, b, unnest(range(1, n + 1)) AS k FROM reps),
    draws AS (SELECT dataset, seed, b, {DRAW.format(keys=f'{seed}, dataset, seed, b, k')} AS idx FROM slots),
    within AS (SELECT d.dataset, d.seed, d.b, {", ".join(f"avg({n}) AS {n}" for n in names)} FROM draws d
        JOIN idx i ON i.dataset = d.dataset AND i.seed = d.seed AND i.idx = d.idx GROUP BY ALL),
    seeds AS (SELECT dataset, list(seed ORDER BY seed) AS seeds, count(*) AS n FROM sizes GROUP BY dataset),
    sreps AS (SELECT dataset, seeds, n, unnest(range(0, {samples})) AS b FROM seeds),
    sslots AS (SELECT *, unnest(range(1, n + 1)) AS slot FROM sreps),
    chosen AS (SELECT dataset, b, seeds[{DRAW.format(keys=f"{seed}, 'seed', dataset, b, slot")} + 1] AS seed FROM sslots),
    dist AS (SELECT c.dataset, c.b, {", ".join(f"avg({n}) AS {n}" for n in names)} FROM chosen c
        JOIN within w ON w.dataset = c.dataset AND w.seed = c.seed AND w.b = c.b GROUP BY ALL),
    points AS (SELECT dataset, 0 AS b, {", ".join(f"avg({n}) AS {n}" for n in names)} FROM (
        SELECT dataset, seed, {", ".join(f"avg({n}) AS {n}" for n in names)} FROM vals GROUP BY ALL) GROUP BY dataset),
    ldist AS ({longs.format('dist')}), lpoints AS ({longs.format('points')})
    SELECT p.dataset, {", ".join("p." + k for k in by.split(", "))}, round(max(p.value), {digits}) AS effect,
           round(quantile_cont(l.value, 0.025), {digits}) AS ci_95_low, round(quantile_cont(l.value, 0.975), {digits}) AS ci_95_high,
           round(least(1.0, 2.0 * least(count(*) FILTER (WHERE l.value <= 1e-12) + 1, count(*) FILTER (WHERE l.value >= -1e-12) + 1) / ({samples} + 1)), {digits}) AS p_value,
           quantile_cont(l.value, 0.025) > 0 OR quantile_cont(l.value, 0.975) < 0 AS significant_95
    FROM lpoints p JOIN ldist l ON l.dataset = p.dataset AND {" AND ".join(f"l.{k} = p.{k}" for k in by.split(", "))}
    GROUP BY p.dataset, {", ".join("p." + k for k in by.split(", "))}"""


def _sign(metric: str) -> str:
    return "-1.0" if metric == "normalized_dtw_distance_mean" else "1.0"


CONTRAST_IDS = {f"v{i}": {"metric": m, "contrast": c} for i, (m, c) in enumerate(CONTRAST_COLUMNS)}


@query("hierarchical_contrasts", "R5 R4 J6", contrast_sql(f"""WITH {RUNS_SQL}, vals AS (SELECT dataset, seed, sample_id,
    {", ".join(f"{_sign(m)} * ({e}) AS v{i}" for i, ((m, c), e) in enumerate(CONTRAST_COLUMNS.items()))} FROM runs GROUP BY dataset, seed, sample_id)""", CONTRAST_IDS))
def _(spark, sf):
    wide = runs(spark, sf).groupBy("dataset", "seed", "sample_id").pivot("condition", CONDITIONS).agg(*[F.first(m).alias(m) for m in METRICS])
    cells = wide.select("dataset", "seed", "sample_id", *[F.col(f"{c}_{m}").alias(f"{m}__{c}") for c in CONDITIONS for m in METRICS])
    return rounded(R.hierarchical_contrasts(cells, METRICS, CONTRASTS, samples=SAMPLES, portable=True), 8)


ONE_CONTRAST = "paired_minus_single_under_joint"


@query("hierarchical_bootstrap", "R4", contrast_sql(f"""WITH {RUNS_SQL}, vals AS (SELECT dataset, seed, sample_id,
    {", ".join(f"{_sign(m)} * ({CONTRAST_COLUMNS[m, ONE_CONTRAST]}) AS v{i}" for i, m in enumerate(METRICS))} FROM runs GROUP BY dataset, seed, sample_id)""",
    {f"v{i}": {"metric": m} for i, m in enumerate(METRICS)}))
def _(spark, sf):
    both = runs(spark, sf).where(F.col("condition").isin("paired_joint", "single_joint"))
    value = lambda m, c: F.max(F.when(F.col("condition") == c, F.col(m)))
    signs = {m: float(_sign(m)) for m in METRICS}
    rows = both.groupBy("dataset", "seed", "sample_id").agg(
        *[(signs[m] * (value(m, "paired_joint") - value(m, "single_joint"))).alias(m) for m in METRICS])
    distribution, points = R.hierarchical_means(rows, METRICS, samples=SAMPLES, portable=True)
    ids = {m: {"metric": m} for m in METRICS}
    return rounded(R.summarise(R.long_values(distribution, ["dataset"], ids, "value"), R.long_values(points, ["dataset"], ids, "effect"),
                               ["dataset", "metric"]), 8)


VERDICT_METRICS = ("rougeL_mean", "bertscore_f1_mean")


@query("bootstrap_verdict", "R14", f"""WITH f AS (SELECT ci_95_low AS lo, ci_95_high AS hi FROM (""" + contrast_sql(f"""WITH {RUNS_SQL}, vals AS (SELECT dataset, seed, sample_id,
    {", ".join(f"({CONTRAST_COLUMNS[m, ONE_CONTRAST]}) AS v{i}" for i, m in enumerate(VERDICT_METRICS))} FROM runs GROUP BY dataset, seed, sample_id)""",
    {f"v{i}": {"metric": m} for i, m in enumerate(VERDICT_METRICS)}) + """)), w AS (
    SELECT count(*) AS comparisons, count(*) FILTER (WHERE lo > 0) AS wins, count(*) FILTER (WHERE hi < 0) AS losses FROM f)
    SELECT *, CASE WHEN wins = comparisons THEN 'consistent_improvement' WHEN wins > 0 AND losses = 0 THEN 'partial_improvement'
                   WHEN losses > 0 THEN 'not_superior' ELSE 'no_clear_difference' END AS verdict FROM w""")
def _(spark, sf):
    rows = runs(spark, sf).where(F.col("condition").isin("paired_joint", "single_joint"))
    value = lambda m, c: F.max(F.when(F.col("condition") == c, F.col(m)))
    wide = rows.groupBy("dataset", "seed", "sample_id").agg(*[(value(m, "paired_joint") - value(m, "single_joint")).alias(m) for m in VERDICT_METRICS])
    ids = {m: {"metric": m} for m in VERDICT_METRICS}
    distribution, points = R.hierarchical_means(wide, list(ids), samples=SAMPLES, portable=True)
    tested = R.summarise(R.long_values(distribution, ["dataset"], ids, "value"), R.long_values(points, ["dataset"], ids, "effect"), ["dataset", "metric"])
    return S.verdict(tested.withColumn("favored", R.favoured("treatment", "control", none="no_clear_difference")))


@query("seed_verdict", "R14", f"""WITH {SEED_SQL}, {ADV_SQL}, f AS (SELECT CASE WHEN m > 0 AND tp < 0.5 THEN 'treatment' WHEN m < 0 AND tp < 0.5 THEN 'control' ELSE 'none' END AS f FROM tp)
    SELECT count(*) AS comparisons, count(*) FILTER (WHERE f = 'treatment') AS wins, count(*) FILTER (WHERE f = 'control') AS losses,
           CASE WHEN count(*) FILTER (WHERE f = 'treatment') = count(*) THEN 'consistent_improvement'
                WHEN count(*) FILTER (WHERE f = 'treatment') > 0 AND count(*) FILTER (WHERE f = 'control') = 0 THEN 'partial_improvement'
                WHEN count(*) FILTER (WHERE f = 'control') > 0 THEN 'not_superior' ELSE 'no_clear_difference' END AS verdict FROM f""")
def _(spark, sf):
    tests = S.paired_tests(advantages(spark, sf), ["dataset", "metric", "control_name"])
    side = F.when((F.col("mean_advantage") > 0) & (F.col("paired_t_p") < 0.5), "treatment").when(
        (F.col("mean_advantage") < 0) & (F.col("paired_t_p") < 0.5), "control").otherwise("none")
    return S.verdict(tests.withColumn("favored", side))


LABEL_ROWS_SQL = f"""lab AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'stage1' ELSE 'manual' END AS dataset, s.seed, d.doc_id AS sample_id, {V.label_sql('d.doc_id')} AS gold,
    CASE WHEN (d.n_chars + s.seed) % 4 = 0 THEN {V.label_sql('d.doc_id * 3')} WHEN (d.n_chars + s.seed) % 37 = 0 THEN '' ELSE {V.label_sql('d.doc_id')} END AS pred_a,
    CASE WHEN (d.n_chars * 3 + s.seed) % 5 = 0 THEN {V.label_sql('d.doc_id + 2')} ELSE {V.label_sql('d.doc_id')} END AS pred_b
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id CROSS JOIN (SELECT unnest({SEEDS}) AS seed) s)"""


def label_rows(spark, sf) -> DataFrame:
    base = _dataset(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    doc, shifted = F.col("doc_id"), F.col("n_chars") + F.col("seed")
    return base.select(
        "dataset", "seed", doc.alias("sample_id"), V.pick_label(doc).alias("gold"),
        F.when(shifted % 4 == 0, V.pick_label(doc * 3)).when(shifted % 37 == 0, F.lit("")).otherwise(V.pick_label(doc)).alias("pred_a"),
        F.when((F.col("n_chars") * 3 + F.col("seed")) % 5 == 0, V.pick_label(doc + 2)).otherwise(V.pick_label(doc)).alias("pred_b"))


@query("mcnemar_exact", "R6 J12", f"""WITH {LABEL_ROWS_SQL}, d AS (SELECT dataset, seed, count(*) FILTER (WHERE gold = pred_a AND gold <> pred_b) AS only_a,
    count(*) FILTER (WHERE gold <> pred_a AND gold = pred_b) AS only_b FROM lab GROUP BY ALL),
    t AS (SELECT *, only_a + only_b AS n, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM d)
    SELECT dataset, CAST(seed AS INTEGER) AS seed, only_a, only_b,
           round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))), 8) AS p_value FROM t GROUP BY ALL""")
def _(spark, sf):
    return rounded(S.mcnemar(label_rows(spark, sf), ["dataset", "seed"]), 8)


@query("common_samples", "J12", V.with_views(["aligned"], """
    SELECT sample_id, trim(emotion_label) AS gold, trim(predicted_emotion_label) AS pred_a, trim(emotion_label) AS pred_b FROM aligned"""))
def _(spark, sf):
    run_a = V.aligned(spark, sf).select("sample_id", "emotion_label", "predicted_emotion_label")
    run_b = V.gold(spark, sf).select("sample_id", "emotion_label", F.col("emotion_label").alias("predicted_emotion_label"))
    return A.common_samples(run_a, run_b)


def label_metric_sql(source: str, keys: str) -> str:
    """Accuracy and fixed-seven macro-F1 per key and system, from weighted (gold, a, b) cells."""
    per = " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS system, v AS label, sum(CASE WHEN gold = v AND {p} = v THEN w ELSE 0 END) AS tp, sum(CASE WHEN gold = v THEN w ELSE 0 END) AS support, "
        f"sum(CASE WHEN {p} = v THEN w ELSE 0 END) AS predicted, sum(w) AS n FROM {source}, (SELECT unnest({V.LABEL_LIST_SQL}) AS v) GROUP BY {keys}, v"
        for s, p in (("a", "pred_a"), ("b", "pred_b")))
    return f"""(SELECT {keys}, metric, max(value) FILTER (WHERE system = 'b') - max(value) FILTER (WHERE system = 'a') AS value FROM (
        SELECT {keys}, system, 'accuracy' AS metric, sum(tp) / max(n)::DOUBLE AS value FROM ({per}) GROUP BY {keys}, system
        UNION ALL SELECT {keys}, system, 'macro_f1', sum(coalesce(2.0 * tp / nullif((support + predicted)::DOUBLE, 0), 0)) / 7.0 FROM ({per}) GROUP BY {keys}, system)
        GROUP BY {keys}, metric)"""


TEST_COLUMNS_SQL = """round(max(p.value), 8) AS difference, round(quantile_cont(d.value, 0.025), 8) AS ci_95_low, round(quantile_cont(d.value, 0.975), 8) AS ci_95_high,
    round(least(1.0, 2.0 * least(count(*) FILTER (WHERE d.value <= 1e-12), count(*) FILTER (WHERE d.value >= -1e-12)) / count(*)), 8) AS p_value,
    quantile_cont(d.value, 0.025) > 0 OR quantile_cont(d.value, 0.975) < 0 AS significant_95"""


@query("label_bootstrap", "R2 A5", f"""WITH {LABEL_ROWS_SQL}, one AS (SELECT *, 1 AS w FROM lab WHERE seed = 42),
    idx AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS idx FROM one),
    sizes AS (SELECT dataset, count(*) AS n FROM one GROUP BY dataset), reps AS (SELECT *, unnest(range(0, {SAMPLES})) AS b FROM sizes),
    slots AS (SELECT *, unnest(range(1, n + 1)) AS k FROM reps),
    draws AS (SELECT dataset, b, {DRAW.format(keys='42, dataset, b, k')} AS idx FROM slots),
    drawn AS (SELECT d.dataset, d.b, gold, pred_a, pred_b, count(*) AS w FROM draws d JOIN idx i ON i.dataset = d.dataset AND i.idx = d.idx GROUP BY ALL),
    dist AS {label_metric_sql('drawn', 'dataset, b')}, points AS {label_metric_sql('one', 'dataset')}
    SELECT p.dataset, p.metric, {TEST_COLUMNS_SQL} FROM points p JOIN dist d ON d.dataset = p.dataset AND d.metric = p.metric GROUP BY p.dataset, p.metric""")
def _(spark, sf):
    pairs = label_rows(spark, sf).where("seed = 42")
    return rounded(R.label_bootstrap(pairs, ["dataset"], SAMPLES, 42, portable=True), 8)


@query("hierarchical_label_bootstrap", "R3", f"""WITH {LABEL_ROWS_SQL}, one AS (SELECT *, 1 AS w FROM lab),
    idx AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY sample_id) - 1 AS idx FROM one),
    sizes AS (SELECT dataset, seed, count(*) AS n FROM one GROUP BY ALL),
    seeds AS (SELECT dataset, list(seed ORDER BY seed) AS seeds, count(*) AS n FROM sizes GROUP BY dataset),
    sreps AS (SELECT *, unnest(range(0, {SAMPLES})) AS b FROM seeds), sslots AS (SELECT *, unnest(range(1, n + 1)) AS slot FROM sreps),
    chosen AS (SELECT dataset, b, slot, seeds[{DRAW.format(keys="42, 'seed', dataset, b, slot")} + 1] AS seed FROM sslots),
    reps AS (SELECT c.*, s.n FROM chosen c JOIN sizes s ON s.dataset = c.dataset AND s.seed = c.seed),
    slots AS (SELECT *, unnest(range(1, n + 1)) AS k FROM reps),
    draws AS (SELECT dataset, seed, b, slot, {DRAW.format(keys='42, dataset, b, slot, k')} AS idx FROM slots),
    drawn AS (SELECT d.dataset, d.b, d.slot, gold, pred_a, pred_b, count(*) AS w FROM draws d
        JOIN idx i ON i.dataset = d.dataset AND i.seed = d.seed AND i.idx = d.idx GROUP BY ALL),
    per AS {label_metric_sql('drawn', 'dataset, b, slot')}, dist AS (SELECT dataset, b, metric, avg(value) AS value FROM per GROUP BY ALL),
    pts AS {label_metric_sql('one', 'dataset, seed')}, points AS (SELECT dataset, metric, avg(value) AS value FROM pts GROUP BY ALL)
    SELECT p.dataset, p.metric, {TEST_COLUMNS_SQL} FROM points p JOIN dist d ON d.dataset = p.dataset AND d.metric = p.metric GROUP BY p.dataset, p.metric""")
def _(spark, sf):
    return rounded(R.hierarchical_label_bootstrap(label_rows(spark, sf), samples=SAMPLES, portable=True), 8)


# --- paired bootstrap of text metrics --------------------------------------------------------

SYSTEMS = {"a": (7, 3), "b": (5, 2)}  # the words each system leaves out: step and phase


def system_scores(counts: DataFrame) -> DataFrame:
    """BLEU statistics and ROUGE-1 of one system from its counts."""
    return O.bleu_statistics(counts, counted=True).join(
        O.rouge_n(counts, orders=(1,), stemmer=False, counted=True).select("sample_id", "rouge1_fmeasure"), "sample_id")


def paired_systems(spark, sf) -> DataFrame:
    """Reference and two systems, each with every ``step``-th word left out."""
    docs = V.documents(spark, sf).select(F.col("doc_id").alias("sample_id"), "text")
    once = with_once(docs, reference_narrative=V.collapse(F.col("text"))).drop("text")
    both = once.withColumns({f"narrative_{s}": V.drop_words(F.col("reference_narrative"), *cut) for s, cut in SYSTEMS.items()})
    counts = O.system_counts(both, {s: f"narrative_{s}" for s in SYSTEMS})
    a, b = (system_scores(counts[s]) for s in SYSTEMS)
    tag = lambda df, t: df.select("sample_id", *[F.col(c).alias(f"{t}_{c}") for c in O.BLEU_STATS], F.col("rouge1_fmeasure").alias(f"rouge1_{t}"))
    return tag(a, "a").join(tag(b, "b"), "sample_id")


def system_sql(name: str, step: int, phase: int) -> str:
    """Per-sample BLEU statistics and ROUGE-1 F of one system, with its own CTE names."""
    view = f"""aligned_{name} AS (SELECT doc_id AS sample_id, {V.norm_sql('text')} AS reference_narrative,
        {V.drop_words_sql(V.norm_sql('text'), step, phase)} AS predicted_narrative FROM documents)"""
    parts = []
    for prefix, tok, orders in (("b", tokens_13a_sql, (1, 2, 3, 4)), ("r", tokens_alnum_sql, (1,))):
        sql = overlap_sql(tok("predicted_narrative"), tok("reference_narrative"), orders)
        for old in ("toks", "grams", "stats"):
            sql = sql.replace(f" {old} ", f" {prefix}{old}_{name} ").replace(f" {old})", f" {prefix}{old}_{name})")
        parts.append(sql.replace("FROM aligned", f"FROM aligned_{name}"))
    scored = f"""sys_{name} AS (SELECT b.*, coalesce(2.0 * r.m1 / nullif((r.t1 + r.f1)::DOUBLE, 0), 0) AS rouge1
        FROM bstats_{name} b JOIN rstats_{name} r ON r.sample_id = b.sample_id)"""
    return view + parts[0] + parts[1] + ", " + scored


STAT_NAMES = [f"{c}{n}" for n in range(1, 5) for c in "mtf"]


def paired_sql() -> str:
    totals = lambda s: ", ".join(f"sum({s}.{c}) AS {c}" for c in STAT_NAMES) + f", avg({s}.rouge1) AS rouge1"
    dist = lambda s: f"""d_{s} AS (SELECT b, {bleu_formula_sql(False)} AS bleu, rouge1 FROM (
        SELECT b, {totals('i')} FROM draws d JOIN idx_{s} i ON i.idx = d.idx GROUP BY b))"""  # noqa: E731
    point = lambda s: f"p_{s} AS (SELECT {bleu_formula_sql(False)} AS bleu, rouge1 FROM (SELECT {totals('i')} FROM idx_{s} i))"
    pick = lambda m, c: f"SELECT '{m}' AS metric, x.{c} AS a, y.{c} AS b, NULL AS d FROM p_a x, p_b y"
    dd = lambda m, c: f"SELECT '{m}' AS metric, x.{c} - y.{c} AS value FROM d_a x JOIN d_b y ON y.b = x.b"
    return f"""WITH {system_sql('a', 7, 3)}, {system_sql('b', 5, 2)},
    idx_a AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM sys_a), idx_b AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM sys_b),
    sizes AS (SELECT count(*) AS n FROM sys_a), reps AS (SELECT n, unnest(range(0, {SAMPLES})) AS b FROM sizes), slots AS (SELECT n, b, unnest(range(1, n + 1)) AS k FROM reps),
    draws AS (SELECT b, {DRAW.format(keys='42, b, k')} AS idx FROM slots),
    {dist('a')}, {dist('b')}, {point('a')}, {point('b')},
    points AS ({pick('bleu_corpus', 'bleu')} UNION ALL {pick('rouge1_mean', 'rouge1')}), dist AS ({dd('bleu_corpus', 'bleu')} UNION ALL {dd('rouge1_mean', 'rouge1')}),
    t AS (SELECT p.metric, max(p.a) AS a, max(p.b) AS b, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi,
        least(1.0, 2.0 * least(count(*) FILTER (WHERE value <= 1e-12) + 1, count(*) FILTER (WHERE value >= -1e-12) + 1) / ({SAMPLES} + 1)) AS p
        FROM points p JOIN dist d ON d.metric = p.metric GROUP BY p.metric)
    SELECT metric, round(a, 6) AS model_a, round(b, 6) AS model_b, round(a - b, 6) AS difference, round(lo, 6) AS ci_95_low, round(hi, 6) AS ci_95_high,
           round(p, 6) AS p_value, lo > 0 OR hi < 0 AS significant_95,
           CASE WHEN lo > 0 THEN 'model_a' WHEN hi < 0 THEN 'model_b' ELSE 'no_significant_difference' END AS favored FROM t"""


@query("paired_bootstrap", "R1 A8 A10", paired_sql())
def _(spark, sf):
    return rounded(R.paired_bootstrap(paired_systems(spark, sf), {"rouge1_mean": "rouge1"}, samples=SAMPLES, portable=True), 6)


PAIR_LIST = [("joint_vs_single", "paired_joint", "single_joint"), ("narrative_vs_single", "paired_narrative", "single_narrative"),
             ("prompt", "paired_joint", "paired_narrative")]
PAIR_METRICS = ["rougeL_mean", "normalized_dtw_distance_mean"]


def family_sql() -> str:
    values = " UNION ALL ".join(
        f"SELECT '{p}_' || dataset AS pair_id, sample_id, " + ", ".join(
            f"max({m}) FILTER (WHERE condition = '{a}') AS {m}_a, max({m}) FILTER (WHERE condition = '{b}') AS {m}_b" for m in PAIR_METRICS)
        + " FROM runs WHERE seed = 42 GROUP BY dataset, sample_id" for p, a, b in PAIR_LIST)
    parts = " UNION ALL ".join(f"SELECT pair_id, '{m}' AS metric, max(pa_{m}) AS a, max(pb_{m}) AS b, quantile_cont(d_{m}, 0.025) AS lo, quantile_cont(d_{m}, 0.975) AS hi, "
                               f"least(1.0, 2.0 * least(count(*) FILTER (WHERE d_{m} <= 1e-12) + 1, count(*) FILTER (WHERE d_{m} >= -1e-12) + 1) / ({SAMPLES} + 1)) AS p "
                               f"FROM dist JOIN pts USING (pair_id) GROUP BY pair_id" for m in PAIR_METRICS)
    return f"""WITH {RUNS_SQL}, vals AS ({values}), idx AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sample_id) - 1 AS idx FROM vals),
    sizes AS (SELECT pair_id, count(*) AS n FROM vals GROUP BY ALL), reps AS (SELECT *, unnest(range(0, {SAMPLES})) AS b FROM sizes),
    slots AS (SELECT *, unnest(range(1, n + 1)) AS k FROM reps), draws AS (SELECT pair_id, b, {DRAW.format(keys='42, pair_id, b, k')} AS idx FROM slots),
    dist AS (SELECT pair_id, b, {", ".join(f"avg({m}_a) - avg({m}_b) AS d_{m}" for m in PAIR_METRICS)} FROM draws JOIN idx USING (pair_id, idx) GROUP BY ALL),
    pts AS (SELECT pair_id, {", ".join(f"avg({m}_a) AS pa_{m}, avg({m}_b) AS pb_{m}" for m in PAIR_METRICS)} FROM vals GROUP BY ALL), t AS ({parts})
    SELECT pair_id, metric, round(a, 8) AS model_a, round(b, 8) AS model_b, round(a - b, 8) AS difference, round(lo, 8) AS ci_95_low, round(hi, 8) AS ci_95_high,
           round(p, 8) AS p_value, lo > 0 OR hi < 0 AS significant_95, CASE WHEN NOT (lo > 0 OR hi < 0) THEN 'no_significant_difference'
           WHEN (lo > 0) = (metric <> 'normalized_dtw_distance_mean') THEN 'model_a' ELSE 'model_b' END AS favored FROM t"""


@query("comparison_family", "R18 R1 J5", family_sql())
def _(spark, sf):
    listed = spark.createDataFrame([(*p, d) for p in PAIR_LIST for d in ("stage1", "manual")], "pair string, run_a string, run_b string, dataset string")
    paired = A.pair_table(runs(spark, sf).where("seed = 42"), listed, PAIR_METRICS, run="condition")
    pairs = paired.withColumn("pair_id", F.concat_ws("_", "pair", "dataset"))
    return rounded(R.paired_bootstrap(pairs, {m: m for m in PAIR_METRICS}, groups=["pair_id"], samples=SAMPLES, bleu=False, portable=True), 8)


@query("run_pairing", "J5", V.with_views(["aligned"], """
    SELECT sample_id, length(predicted_narrative) AS chars_a, length(reference_narrative) AS chars_b FROM aligned"""))
def _(spark, sf):
    run_a = V.aligned(spark, sf).select("sample_id", "reference_narrative", "predicted_narrative")
    run_b = run_a.select("sample_id", "reference_narrative", F.col("reference_narrative").alias("predicted_narrative"))
    both = A.pair_runs(run_a, run_b)
    return both.select("sample_id", F.length("predicted_narrative_a").alias("chars_a"), F.length("predicted_narrative_b").alias("chars_b"))
