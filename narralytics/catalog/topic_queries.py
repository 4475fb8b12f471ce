"""Vector, topic and similarity queries over embeddings and documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.catalog import views as V
from narralytics.catalog.registry import query
from narralytics.catalog.stats_queries import rounded
from narralytics.catalog.text_queries import SENTENCES_SQL, tokens_13a_sql
from narralytics.constants import STOP_WORDS
from narralytics.functions.text import cluster_text
from narralytics.operators import density as D
from narralytics.operators import semantic as M
from narralytics.operators import similarity as N
from narralytics.operators import topics as T

COS_SQL = "(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))"
VECTORS_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def vectors(spark, sf) -> DataFrame:
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("topic_id"))


def prototypes(spark, sf) -> DataFrame:
    """Codebook vectors: the centroid of each label over the whole table (ten rows)."""
    return T.centroids(vectors(spark, sf)).select("topic_id", F.col("centroid").alias("vec"))


CENTROID_SQL = """c AS (SELECT label, list(m ORDER BY i) AS v, any_value(n) AS n FROM (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM
    (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY label, i) GROUP BY label)"""
CANDIDATE_SQL = f"""WITH {VECTORS_SQL}, {CENTROID_SQL}, s AS (SELECT a.vec_id AS cluster_id, b.label AS topic_id, {COS_SQL} AS similarity FROM e a, c b),
    cand AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, topic_id) AS rank FROM s QUALIFY rank <= 3)"""


def clusters(spark, sf) -> DataFrame:
    """Every vector as a cluster: its id, a name and a size."""
    return vectors(spark, sf).select(F.col("id").alias("cluster_id"), F.concat(F.lit("cluster_"), F.col("id").cast("string")).alias("cluster_name"),
                                     ((F.col("id") * 37) % 500 + 1).alias("cluster_count"), "vec")


def candidates(spark, sf) -> DataFrame:
    return T.rank_candidates(clusters(spark, sf), prototypes(spark, sf))


def names(spark, sf) -> DataFrame:
    return prototypes(spark, sf).select("topic_id", F.concat(F.lit("topic_"), F.col("topic_id").cast("string")).alias("name"),
                                        F.concat(F.lit("text of "), F.col("topic_id").cast("string")).alias("prototype_text"))


@query("codebook_candidates", "V1 W4", CANDIDATE_SQL + "SELECT cluster_id, CAST(rank AS INTEGER) AS rank, topic_id::BIGINT AS topic_id, round(similarity, 6) AS similarity FROM cand")
def _(spark, sf):
    return rounded(candidates(spark, sf), 6)


REVIEW = ", ".join(f"max(topic_id) FILTER (WHERE rank = {r})::BIGINT AS candidate_{r}_id, 'topic_' || max(topic_id) FILTER (WHERE rank = {r}) AS candidate_{r}_name, "
                   f"round(max(similarity) FILTER (WHERE rank = {r}), 6) AS candidate_{r}_similarity" for r in (1, 2, 3))


@query("codebook_review_table", "S1 W4", CANDIDATE_SQL + f"""SELECT cluster_id, 'cluster_' || cluster_id AS cluster_name, cluster_id * 37 % 500 + 1 AS cluster_count, {REVIEW},
    '' AS manual_final_topic_id, '' AS manual_final_topic_name, '' AS manual_decision, '' AS notes FROM cand GROUP BY cluster_id""")
def _(spark, sf):
    return T.review_table(clusters(spark, sf), candidates(spark, sf), names(spark, sf))


@query("candidates_nested", "V1 IO8", CANDIDATE_SQL + """SELECT cluster_id, string_agg('topic_' || topic_id || '=' || rank, ',' ORDER BY rank) AS candidates FROM cand GROUP BY cluster_id""")
def _(spark, sf):
    nested = T.nested_candidates(candidates(spark, sf), names(spark, sf))
    text = F.transform("cap_candidates", lambda c: F.concat_ws("=", c["cap_topic_name"], c["rank"].cast("string")))
    return nested.select("cluster_id", F.array_join(text, ",").alias("candidates"))


@query("candidate_similarity", "A23", CANDIDATE_SQL + """SELECT cluster_id, 'cluster_' || cluster_id AS cluster_name, cluster_id * 37 % 500 + 1 AS cluster_count,
    round(avg(similarity), 6) AS avg_top3_similarity, round(max(similarity), 6) AS top1_similarity FROM cand GROUP BY cluster_id""")
def _(spark, sf):
    return rounded(T.candidate_similarity(clusters(spark, sf), candidates(spark, sf)), 6)


def selected(spark, sf) -> DataFrame:
    return V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("topic_id"))


@query("cluster_dataset_summary", "A24", CANDIDATE_SQL + """, m AS (SELECT cluster_id, avg(similarity) AS s FROM cand GROUP BY cluster_id)
    SELECT count(*) AS num_clusters, count(*) FILTER (WHERE cluster_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS num_selected_clusters,
           round(avg(s), 6) AS average_top3_similarity, 'embeddings' AS dataset FROM m""")
def _(spark, sf):
    similarity = T.candidate_similarity(clusters(spark, sf), candidates(spark, sf))
    return rounded(T.dataset_summary(similarity, selected(spark, sf), "embeddings"), 6)


@query("clusters_by_size", "S3 A24", """SELECT vec_id AS cluster_id, vec_id * 37 % 500 + 1 AS cluster_count FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    return T.clusters_by_size(clusters(spark, sf), selected(spark, sf)).select("cluster_id", "cluster_count")


NEAREST_SQL = f"""WITH {VECTORS_SQL}, d AS (SELECT a.vec_id, greatest(0, least(2, 1 - max({COS_SQL}))) AS distance
    FROM e a, e b WHERE a.label < 5 AND b.label >= 5 GROUP BY a.vec_id)"""


@query("nearest_neighbour_distance", "V2", NEAREST_SQL + " SELECT vec_id AS left_id, round(distance, 6) AS distance FROM d")
def _(spark, sf):
    both = vectors(spark, sf)
    return rounded(N.nearest_distance(both.where("topic_id < 5"), both.where("topic_id >= 5")), 6)


@query("nearest_neighbour_stats", "V2", NEAREST_SQL + " SELECT round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.95), 6) AS p95 FROM d")
def _(spark, sf):
    both = vectors(spark, sf)
    return rounded(N.nearest_neighbour_stats(both.where("topic_id < 5"), both.where("topic_id >= 5")), 6)


@query("reduced_embeddings", "V7")
def _(spark, sf):
    reduced = T.reduce_dimensions(vectors(spark, sf), k=50)
    return reduced.select("id", F.posexplode("reduced").alias("dim", "value"))


@query("topic_clusters", "V8")
def _(spark, sf):
    return T.cluster_topics(vectors(spark, sf).drop("topic_id"), k=10, components=5, min_size=20).select("id", "topic_id")


@query("topic_density", "V8", f"""WITH {VECTORS_SQL}, s AS (SELECT a.vec_id AS id, {COS_SQL} AS c FROM e a, e b WHERE a.vec_id <> b.vec_id)
    SELECT id, round(sqrt(greatest(0, 2 - 2 * list_sort(list(c), 'DESC')[10])), 6) AS core_distance FROM s GROUP BY id""")
def _(spark, sf):
    cores = D.core_distances(D.nearest_others(vectors(spark, sf), 10), 10)
    return cores.select("id", F.round("core", 6).alias("core_distance"))


@query("density_topics", "V8")
def _(spark, sf):
    return D.density_topics(vectors(spark, sf), min_samples=5, min_size=20)


@query("topic_centroids", "V10", f"WITH {VECTORS_SQL}, {CENTROID_SQL} SELECT label AS topic_id, CAST(i AS INTEGER) AS dim, round(v[i], 6) AS value FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM c)")
def _(spark, sf):
    return T.centroids(vectors(spark, sf)).select("topic_id", F.posexplode("centroid").alias("p", "v")).select(
        "topic_id", (F.col("p") + 1).alias("dim"), F.round("v", 6).alias("value"))


@query("representative_rows", "V10 W4", f"""WITH {VECTORS_SQL}, {CENTROID_SQL}, s AS (SELECT a.vec_id, a.label, {COS_SQL} AS similarity FROM e a JOIN c b ON b.label = a.label)
    SELECT label AS topic_id, CAST(rank AS INTEGER) AS rank, vec_id AS id, round(similarity, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _(spark, sf):
    return rounded(T.representative_rows(vectors(spark, sf), "id").select("topic_id", "rank", "id", "similarity"), 6)


STOP_SQL = tuple(STOP_WORDS)
TERMS_SQL = rf"""WITH toks AS (SELECT source AS topic, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN {STOP_SQL}) AS t FROM documents),
    terms AS (SELECT topic, unnest(t) AS term FROM toks UNION ALL SELECT topic, t[i] || ' ' || t[i + 1] FROM (SELECT topic, t, unnest(range(1, len(t))) AS i FROM toks)),
    counts AS (SELECT topic, term, count(*) AS n FROM terms GROUP BY ALL), f AS (SELECT term, sum(n) AS f FROM counts GROUP BY term HAVING count(*) >= 5),
    kept AS (SELECT c.*, f.f FROM counts c JOIN f ON f.term = c.term), sizes AS (SELECT topic, sum(n) AS total FROM kept GROUP BY topic),
    w AS (SELECT k.topic, k.term, k.n / s.total::DOUBLE * ln(1.0 + (SELECT avg(total) FROM sizes) / k.f::DOUBLE) AS weight FROM kept k JOIN sizes s ON s.topic = k.topic),
    top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rank FROM w QUALIFY rank <= 10)"""


def doc_topics(spark, sf) -> DataFrame:
    return V.documents(spark, sf).select("doc_id", "text", F.col("source").alias("topic_id"))


@query("topic_terms", "V9 W4 T22", TERMS_SQL + " SELECT topic AS topic_id, CAST(rank AS INTEGER) AS rank, term, round(weight, 9) AS weight FROM top")
def _(spark, sf):
    return rounded(T.topic_terms(doc_topics(spark, sf)))


@query("topic_table", "V11 T7", TERMS_SQL + r""", docs AS (SELECT source AS topic, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
        row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents),
    cut AS (SELECT topic, r, CASE WHEN length(text) <= 600 THEN text ELSE rtrim(substr(text, 1, 597)) || '...' END AS text FROM docs WHERE r <= 3),
    lists AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS terms, topic || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name FROM top GROUP BY topic)
    SELECT l.topic AS topic_id, (SELECT count(*) FROM documents d WHERE d.source = l.topic) AS "count", l.name,
           'Cluster name: ' || l.name || '. Top terms: ' || l.terms || '. Representative documents: ' || string_agg(c.text, ' ' ORDER BY c.r) AS cluster_text
    FROM lists l JOIN cut c ON c.topic = l.topic GROUP BY l.topic, l.name, l.terms""")
def _(spark, sf):
    docs = doc_topics(spark, sf)
    reps = T.top_per_group(docs, ["topic_id"], [F.length("text").desc(), F.col("doc_id")], 5)
    table = T.topic_table(docs, T.topic_terms(docs), reps, noise="-1")
    return table.select("topic_id", "count", "name", cluster_text(F.col("name"), F.col("top_terms"), F.col("representative_docs")).alias("cluster_text"))


@query("encoded_sentences", "V6 UDF3", f"""
    WITH w AS (SELECT doc_id, unnest(string_split(lower({V.norm_sql('text')}), ' ')) AS word FROM documents),
    h AS (SELECT doc_id, md5('7:' || word) AS h FROM w WHERE word <> '')
    SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 32 AS INTEGER) AS dim,
           sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM h GROUP BY ALL HAVING value <> 0""")
def _(spark, sf):
    """Sentence vectors summed per document; dimensions whose total is 0 are left out."""
    encoded = M.encode_sentences(V.documents(spark, sf).select("doc_id", "text"), "doc_id", ["text"])
    return M.summed_vectors(encoded, "doc_id", M.HashingEncoder().dim).where("value <> 0")


# a token that stands on both sides has its best match there, unless its vector is zero; only the others meet all tokens of the other side
# unit vectors of hashed features: the signs of a text's features summed per dimension; a text without features has the zero vector
def unit_sql(features: str, seed: int, keys: str) -> str:
    """CTEs f, d, u: (keys, u) from ``features``, a select of (keys, feature)."""
    return f"""f AS MATERIALIZED ({features}),
    k AS (SELECT DISTINCT feature FROM f), h AS MATERIALIZED (SELECT feature, ('0x' || substr(md5('{seed}:' || feature), 1, 8))::BIGINT % 32 AS dim,
        CASE WHEN ('0x' || substr(md5('{seed}:' || feature), 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM k WHERE feature <> ''),
    d AS (SELECT {keys}, dim, sum(sign) AS x FROM f JOIN h ON h.feature = f.feature GROUP BY {keys}, dim),
    m AS (SELECT {keys}, map_from_entries(list((dim, x))) AS x, sqrt(sum(x * x)) AS norm FROM d GROUP BY {keys}),
    u AS MATERIALIZED (SELECT {keys}, list_transform(range(0, 32), lambda i: CASE WHEN norm > 0 THEN coalesce(x[i], 0) / norm ELSE 0.0 END) AS u FROM m)"""


SPLIT_SQL = SENTENCES_SQL.replace("text", "{0}")
SENTENCE_SQL = V.with_views(["aligned"], f""", t AS MATERIALIZED (SELECT sample_id, {SPLIT_SQL.format('reference_narrative')} AS a, {SPLIT_SQL.format('predicted_narrative')} AS b FROM aligned),
    q AS MATERIALIZED (SELECT DISTINCT unnest(a) AS sentence FROM t UNION SELECT DISTINCT unnest(b) FROM t),
    {unit_sql("SELECT sentence, unnest(string_split(lower(sentence), ' ')) AS feature FROM q", 7, "sentence")},
    e AS (SELECT sample_id, side, list(u ORDER BY pos) AS u FROM (SELECT sample_id, side, pos, coalesce(u.u, list_transform(range(0, 32), lambda i: 0.0)) AS u FROM (
            SELECT sample_id, 'a' AS side, unnest(a) AS sentence, unnest(range(1, len(a) + 1)) AS pos FROM t UNION ALL SELECT sample_id, 'b', unnest(b), unnest(range(1, len(b) + 1)) FROM t) x
            LEFT JOIN u ON u.sentence = x.sentence) GROUP BY sample_id, side),
    g AS MATERIALIZED (SELECT x.sample_id, len(x.u) AS n, len(y.u) AS m, list_transform(x.u, lambda p: list_transform(y.u, lambda r: 1 - list_dot_product(p, r))) AS cost
        FROM e x JOIN e y ON y.sample_id = x.sample_id AND x.side = 'a' AND y.side = 'b'),
    w AS (SELECT sample_id, 1 AS d, list_transform(range(0, n + 1), lambda i: CAST('infinity' AS DOUBLE)) AS c1,
            list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE CAST('infinity' AS DOUBLE) END) AS c2 FROM g
        UNION ALL SELECT w.sample_id, d + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i < 1 OR d + 1 - i > m THEN CAST('infinity' AS DOUBLE)
            ELSE least(c1[i], c1[i + 1], c2[i]) + cost[i][d + 1 - i] END), c1 FROM w JOIN g ON g.sample_id = w.sample_id WHERE d < n + m)
    SELECT t.sample_id, round(c, 6) AS dtw_distance, round(c / (n + m), 6) AS normalized_dtw_distance FROM t LEFT JOIN (
        SELECT w.sample_id, c1[n + 1] AS c, n, m FROM w JOIN g ON g.sample_id = w.sample_id WHERE d = n + m) z ON z.sample_id = t.sample_id""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("sentence_alignment", "V3 V6", SENTENCE_SQL)
def _(spark, sf):
    return rounded(M.sentence_dtw(V.aligned(spark, sf)), 6)


TOKENS = tokens_13a_sql
GREEDY_SQL = V.with_views(["aligned"], f""", t AS MATERIALIZED (SELECT sample_id, list_filter({TOKENS('predicted_narrative')}, lambda w: w <> '') AS h, list_filter({TOKENS('reference_narrative')}, lambda w: w <> '') AS r FROM aligned),
    q AS MATERIALIZED (SELECT DISTINCT unnest(h) AS token FROM t UNION SELECT DISTINCT unnest(r) FROM t),
    {unit_sql("SELECT token, substr('^' || lower(token) || '$', i, 3) AS feature FROM (SELECT token, unnest(range(1, greatest(1, length(token)) + 1)) AS i FROM q)", 11, "token")},
    c AS MATERIALIZED (SELECT sample_id, side, token, count(*) AS n FROM (SELECT sample_id, 'h' AS side, unnest(h) AS token FROM t UNION ALL SELECT sample_id, 'r', unnest(r) FROM t) GROUP BY ALL),
    o AS (SELECT sample_id, token, count(*) = 2 AS both FROM c GROUP BY sample_id, token),
    x AS MATERIALIZED (SELECT c.*, u.u, o.both AND list_dot_product(u.u, u.u) > 0 AS sure FROM c JOIN o ON o.sample_id = c.sample_id AND o.token = c.token JOIN u ON u.token = c.token),
    b AS (SELECT x.sample_id, x.side, any_value(x.n) AS n, max(list_dot_product(x.u, y.u)) AS c FROM x JOIN x y ON y.sample_id = x.sample_id AND y.side <> x.side WHERE NOT x.sure
        GROUP BY x.sample_id, x.side, x.token),
    v AS (SELECT sample_id, side, sum(n * c) / sum(n) AS c FROM (SELECT sample_id, side, n, c FROM b UNION ALL SELECT sample_id, side, n, 1.0 FROM x WHERE sure) GROUP BY sample_id, side),
    p AS (SELECT sample_id, c AS p FROM v WHERE side = 'h'), l AS (SELECT sample_id, c AS r FROM v WHERE side = 'r')
    SELECT t.sample_id, round(p, 6) AS bertscore_precision, round(l.r, 6) AS bertscore_recall, round(CASE WHEN p + l.r = 0 THEN 0 ELSE 2 * p * l.r / (p + l.r) END, 6) AS bertscore_f1
    FROM t LEFT JOIN p ON p.sample_id = t.sample_id LEFT JOIN l ON l.sample_id = t.sample_id""")


@query("greedy_token_match", "V5", GREEDY_SQL)
def _(spark, sf):
    return rounded(M.greedy_match(V.aligned(spark, sf)), 6)


def unrounded(sql: str, *columns: str) -> str:
    for c in columns:
        sql = sql.replace(f"round({c}, 6)", c)
    return sql


GREEDY_F1 = "CASE WHEN p + l.r = 0 THEN 0 ELSE 2 * p * l.r / (p + l.r) END"


@query("semantic_means", "V3 V5 A12", f"""SELECT unnest(['bertscore_f1_mean', 'dtw_distance_mean', 'normalized_dtw_distance_mean']) AS metric,
        unnest([round(avg(bertscore_f1), 6), round(avg(dtw_distance), 6), round(avg(normalized_dtw_distance), 6)]) AS value
    FROM ({unrounded(SENTENCE_SQL, "c", "c / (n + m)")}) x JOIN ({unrounded(GREEDY_SQL, GREEDY_F1)}) y ON y.sample_id = x.sample_id""")
def _(spark, sf):
    both = V.aligned(spark, sf)
    return rounded(M.semantic_summary(M.sentence_dtw(both).join(M.greedy_match(both), "sample_id")), 6)


# the grid is walked by anti-diagonals; entry i of a diagonal's list belongs to row i - 1, entry 1 to the border
ALIGN_SQL = f"""WITH RECURSIVE {VECTORS_SQL}, p AS (SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS pair, label < 5 AS side, vec_id,
        list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
    s AS (SELECT pair, list(u ORDER BY vec_id) FILTER (WHERE side) AS a, list(u ORDER BY vec_id) FILTER (WHERE NOT side) AS b FROM p GROUP BY pair),
    g AS (SELECT pair, len(a) AS n, len(b) AS m, list_transform(a, lambda x: list_transform(b, lambda y: greatest(0, least(2, 1 - list_dot_product(x, y))))) AS cost FROM s),
    w AS (SELECT pair, 1 AS d, n, m, cost, list_transform(range(0, n + 1), lambda i: CAST('infinity' AS DOUBLE)) AS c1, list_transform(range(0, n + 1), lambda i: 0::BIGINT) AS s1,
            list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE CAST('infinity' AS DOUBLE) END) AS c2, list_transform(range(0, n + 1), lambda i: 0::BIGINT) AS s2 FROM g
        UNION ALL SELECT pair, d + 1, n, m, cost,
            list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i < 1 OR d + 1 - i > m THEN CAST('infinity' AS DOUBLE) ELSE least(c1[i], c1[i + 1], c2[i]) + cost[i][d + 1 - i] END),
            list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i < 1 OR d + 1 - i > m THEN 0 WHEN c1[i] <= least(c1[i + 1], c2[i]) THEN s1[i] + 1 WHEN c1[i + 1] <= c2[i] THEN s1[i + 1] + 1 ELSE s2[i] + 1 END),
            c1, s1 FROM w WHERE d < n + m)
    SELECT pair, round(c1[n + 1], 6) AS dtw_distance, round(c1[n + 1] / (n + m), 6) AS normalized_dtw_distance, round(c1[n + 1] / s1[n + 1], 6) AS path_normalized_dtw_distance,
           s1[n + 1] AS dtw_path_length FROM w WHERE d = n + m"""


@query("corpus_alignment", "V4", ALIGN_SQL)
def _(spark, sf):
    both = vectors(spark, sf).withColumn("pair", F.when(F.col("topic_id") % 2 == 0, "even").otherwise("odd"))
    side = lambda keep: positions(both.where(keep))
    found = N.align_sequences(side("topic_id < 5"), side("topic_id >= 5"), ["pair"])
    return rounded(found.withColumn("dtw_path_length", F.col("dtw_path_length").cast("long")), 6)


def positions(rows: DataFrame) -> DataFrame:
    """Position of a vector within its pair, in id order."""
    from narralytics.operators.ranking import rank_by_value
    return rank_by_value(rows, "id", ["pair"]).select("pair", (F.col("rank") - 1).alias("pos"), "vec")
