"""One query per operator over its whole table, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralytics.llm import (bpe, centroids, embed_dedup, hard_negatives, html_extract, line_dedup, media, mixing, pii, quality, simhash, token_count,
                             word_lm)
from narralytics.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measure(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = word_lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scores.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_embedding_dedup, op4_media_chunks, op5_quality, op6_token_counts,
                                   op7_bpe, op8_mixing, op9_lm_difference, op10_html, op11_centroids, op12_hard_negatives, op13_line_dedup)}


def _clustering_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """k-means with every distance computed: integers as doubles are exact here."""
    ctes = ["""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM
        (SELECT v, sha256('2:' || vec_id) AS h FROM x ORDER BY h, v LIMIT {k}))"""]
    distance = "list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM
        (SELECT x.vec_id, x.v, c.j, {distance} AS d FROM x, c{i} c) GROUP BY vec_id, v)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(floor(s / n) ORDER BY i) AS c FROM
        (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT j, v, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY j, i) GROUP BY j) m ON m.j = c.j)""")
    return "WITH " + ",\n".join(ctes) + f""" SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c.c, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


SQL: dict[str, str] = {
    # the tables hold no ideographs, which the operator takes one by one
    "op9_lm_difference": r"""WITH texts AS (SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT item_id, text, true FROM benchmark),
        s AS MATERIALIZED (SELECT target, doc_id, list_append(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{M}\p{N}]'), '</s>') AS w FROM texts),
        g AS MATERIALIZED (SELECT target, doc_id, i, w[i] AS w, CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END AS v FROM (SELECT target, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s)),
        c AS MATERIALIZED (SELECT v, w, count(*) FILTER (WHERE target) AS t, count(*) FILTER (WHERE NOT target) AS b FROM g GROUP BY v, w),
        o AS MATERIALIZED (SELECT w, sum(t) AS t, sum(b) AS b FROM c GROUP BY w),
        x AS MATERIALIZED (SELECT v, sum(t) AS t, sum(b) AS b FROM c GROUP BY v),
        n AS (SELECT count(*) AS words, sum(t) AS t, sum(b) AS b FROM o),
        x0 AS (SELECT w AS v, t, b FROM o WHERE w <> '</s>' UNION ALL SELECT v, t, b FROM x WHERE v = '<s>'),
        l AS MATERIALIZED (SELECT c.v, c.w, -log2((c.t + 16 * ((o.t + 16 / n.words) / (n.t + 16))) / (x0.t + 16)) AS t, -log2((c.b + 16 * ((o.b + 16 / n.words) / (n.b + 16))) / (x0.b + 16)) AS b
            FROM c JOIN o ON o.w = c.w JOIN x0 ON x0.v = c.v, n),
        d AS (SELECT doc_id, count(*) AS n_tokens, avg(l.t) AS t, avg(l.b) AS b FROM g JOIN l ON l.v = g.v AND l.w = g.w WHERE NOT target GROUP BY doc_id)
        SELECT doc_id, n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS difference FROM d""",
    "op11_centroids": _clustering_sql(),
    "op12_hard_negatives": """WITH x AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM x a, x b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
            s.other AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op13_line_dedup": r"""WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        k AS MATERIALIZED (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND k.doc_id <> last) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR k.doc_id = last), '')) AS kept_sha256
        FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id""",
}   # the other results cannot be said in SQL over the whole tables; tests/llm holds each against brute force
