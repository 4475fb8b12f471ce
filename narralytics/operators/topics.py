"""Topic clustering, topic descriptions and ranking against a policy codebook."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralytics.constants import POLICY_TOPICS, STOP_WORDS
from narralytics.functions.text import cluster_text, ngrams
from narralytics.operators.ranking import top_per_group
from narralytics.operators.similarity import cosine_top_k
from narralytics.session import small_side, stored


def reduce_dimensions(df: DataFrame, vec: str = "vec", k: int = 50, out: str = "reduced") -> DataFrame:
    """PCA projection of an array column."""
    vectors = df.withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    return model.transform(vectors).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def cluster_topics(df: DataFrame, vec: str = "vec", k: int = 10, components: int | None = 5, min_size: int = 120,
                   seed: int = 42, out: str = "topic_id") -> DataFrame:
    """Topic id per row; clusters under the minimum size become noise (-1), the rest keep size order."""
    reduced = reduce_dimensions(df, vec, components, "_r") if components else df.withColumn("_r", F.col(vec).cast("array<double>"))
    vectors = reduced.withColumn("_v", array_to_vector("_r")).drop("_r")
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vectors)
    assigned = model.transform(vectors).drop("_v")
    sizes = assigned.groupBy("_c").agg(F.count("*").alias("_n"))  # at most k rows
    order = F.row_number().over(Window.partitionBy(F.col("_n") >= min_size).orderBy(F.desc("_n"), "_c")) - 1
    ids = sizes.select("_c", F.when(F.col("_n") >= min_size, order).otherwise(-1).cast("int").alias(out))
    return assigned.join(ids, "_c").drop("_c")


def term_lists(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Lower-case words of two letters or more without stop words, plus their bigrams."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(list(stop_words)))
    both = F.transform(F.array(tokens), lambda t: F.concat(t, ngrams(t, 2)))
    return F.element_at(both, 1)


WIDE_TOPICS = 32  # topics whose counts travel as columns of one row per term


def _term_counts(terms: DataFrame, topic: str, min_topics: int) -> DataFrame:
    """(topic, term, n, f) of the terms of at least ``min_topics`` topics; ``f`` is the term's count over all topics."""
    names = [r[0] for r in terms.select(topic).distinct().limit(WIDE_TOPICS + 1).collect()]
    long = terms.select(topic, F.explode("_terms").alias("term"))
    if 0 < len(names) <= WIDE_TOPICS:  # one row per term and task is shuffled, and only once
        kind = terms.schema[topic].dataType
        per_term = long.groupBy("term").agg(*[F.count_if(F.col(topic).eqNullSafe(F.lit(x).cast(kind))).alias(f"_n{i}") for i, x in enumerate(names)])
        parts = F.filter(F.array(*[F.struct(F.lit(x).cast(kind).alias(topic), F.col(f"_n{i}").alias("n")) for i, x in enumerate(names)]), lambda e: e["n"] > 0)
        packed = per_term.select("term", parts.alias("parts"))
    else:
        counts = long.groupBy(topic, "term").agg(F.count("*").alias("n"))
        packed = counts.groupBy("term").agg(F.collect_list(F.struct(topic, "n")).alias("parts"))
    both = packed.where(F.size("parts") >= min_topics).withColumn("f", F.aggregate("parts", F.lit(0).cast("long"), lambda s, e: s + e["n"]))
    return both.select("term", "f", F.explode("parts").alias("p")).select(F.col(f"p.{topic}").alias(topic), "term", F.col("p.n").alias("n"), "f")


def topic_terms(df: DataFrame, text: str = "text", topic: str = "topic_id", min_topics: int = 5, k: int = 10,
                stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Top terms per topic by class-based TF-IDF; a term must occur in ``min_topics`` topics."""
    # texts are tokenised once; every later step reads the written counts of the terms that stay
    kept = stored(_term_counts(df.select(topic, term_lists(F.col(text), stop_words).alias("_terms")), topic, min_topics), "term-counts")
    sizes = kept.groupBy(topic).agg(F.sum("n").alias("topic_total"))
    average = sizes.withColumn("average", F.avg("topic_total").over(Window.partitionBy()))  # one row per topic
    weighted = kept.join(small_side(average), topic).withColumn(
        "weight", F.col("n") / F.col("topic_total") * F.ln(1.0 + F.col("average") / F.col("f")))
    return top_per_group(weighted, [topic], [F.desc(F.round("weight", 12)), F.col("term")], k).select(topic, "rank", "term", "weight")


def centroids(df: DataFrame, vec: str = "vec", topic: str = "topic_id") -> DataFrame:
    return df.groupBy(topic).agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, 0 when either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def representative_rows(df: DataFrame, key: str, vec: str = "vec", topic: str = "topic_id", k: int = 5) -> DataFrame:
    """Rows closest to the centroid of their topic."""
    scored = df.join(small_side(centroids(df, vec, topic)), topic).withColumn("similarity", cosine(F.col(vec), F.col("centroid"))).drop("centroid")
    return top_per_group(scored, [topic], [F.desc(F.round("similarity", 12)), F.col(key)], k)


def topic_table(assignments: DataFrame, terms: DataFrame, representatives: DataFrame, text: str = "text", topic: str = "topic_id",
                noise: int = -1) -> DataFrame:
    """Nested summary per topic without noise: count, name, top terms and representative texts."""
    counts = assignments.groupBy(topic).agg(F.count("*").alias("count"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rank", c))), lambda e: e[c])
    top = terms.groupBy(topic).agg(ordered("term").alias("top_terms"))
    docs = representatives.groupBy(topic).agg(ordered(text).alias("representative_docs"))
    joined = counts.where(F.col(topic) != noise).join(top, topic, "left").join(docs, topic, "left")
    name = F.concat_ws("_", F.col(topic).cast("string"), F.slice("top_terms", 1, 4))
    return joined.select(topic, "count", name.alias("name"), "top_terms", "representative_docs")


def policy_codebook(spark: SparkSession, descriptions: dict[int, str] | None = None) -> DataFrame:
    """Codebook table; a description defaults to a sentence made of the topic name."""
    texts = descriptions or {}
    rows = [(i, name, texts.get(i, f"{name}: issues related to {name.lower()} policy.")) for i, name in POLICY_TOPICS.items()]
    return spark.createDataFrame(rows, "topic_id int, name string, prototype_text string")


def with_cluster_text(summary: DataFrame) -> DataFrame:
    return summary.withColumn("cluster_text", cluster_text(F.col("name"), F.col("top_terms"), F.col("representative_docs")))


def rank_candidates(clusters: DataFrame, prototypes: DataFrame, k: int = 3) -> DataFrame:
    """(cluster_id, rank, topic_id, similarity) of the k most similar prototypes per cluster."""
    found = cosine_top_k(clusters.select(F.col("cluster_id").cast("long").alias("id"), "vec"),
                         prototypes.select(F.col("topic_id").cast("long").alias("id"), "vec"), k)
    return found.select(F.col("left_id").alias("cluster_id"), "rank", F.col("right_id").alias("topic_id"), "similarity")


def review_table(clusters: DataFrame, candidates: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """One row per cluster with its ranked candidates and blank columns for the reviewer."""
    named = candidates.join(names.select(F.col("topic_id").cast("long").alias("topic_id"), "name"), "topic_id")
    wide = named.groupBy("cluster_id").pivot("rank", list(range(1, k + 1))).agg(
        F.first("topic_id").alias("id"), F.first("name").alias("name"), F.round(F.first("similarity"), 6).alias("similarity"))
    columns = [F.col(f"{r}_{c}").alias(f"candidate_{r}_{c}") for r in range(1, k + 1) for c in ("id", "name", "similarity")]
    blank = [F.lit("").alias(c) for c in ("manual_final_topic_id", "manual_final_topic_name", "manual_decision", "notes")]
    joined = clusters.select("cluster_id", "cluster_name", "cluster_count").join(wide, "cluster_id")
    return joined.select("cluster_id", "cluster_name", "cluster_count", *columns, *blank).orderBy(
        F.desc("candidate_1_similarity"), F.desc("cluster_count"), "cluster_id")


def nested_candidates(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates of a cluster as one array of structs, best first."""
    named = candidates.join(names.select(F.col("topic_id").cast("long").alias("topic_id"), "name", "prototype_text"), "topic_id")
    entry = F.struct("rank", F.col("topic_id").alias("cap_topic_id"), F.col("name").alias("cap_topic_name"), "similarity", "prototype_text")
    return named.groupBy("cluster_id").agg(F.sort_array(F.collect_list(entry)).alias("cap_candidates"))


def candidate_similarity(clusters: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the first k candidate similarities and the best one; clusters without any are dropped."""
    means = candidates.where(F.col("rank") <= k).groupBy("cluster_id").agg(
        F.avg("similarity").alias("avg_top3_similarity"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top1_similarity"))
    return clusters.select("cluster_id", "cluster_name", "cluster_count").join(means, "cluster_id")


def dataset_summary(similarity: DataFrame, selected: DataFrame, dataset: str) -> DataFrame:
    """Cluster counts, the selected subset and the overall mean of means."""
    flagged = similarity.join(selected.select(F.col("topic_id").alias("cluster_id")).distinct().withColumn("_s", F.lit(1)), "cluster_id", "left")
    return flagged.agg(F.count("*").alias("num_clusters"), F.count("_s").alias("num_selected_clusters"),
                       F.avg("avg_top3_similarity").alias("average_top3_similarity")).withColumn("dataset", F.lit(dataset))


def clusters_by_size(similarity: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = selected.select(F.col("topic_id").alias("cluster_id")).distinct()
    return similarity.join(chosen, "cluster_id", "left_semi").orderBy(F.desc("cluster_count"), "cluster_id")
