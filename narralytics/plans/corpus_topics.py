"""Corpus to topics: filter, sample, encode, cluster, describe, rank against the codebook."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.functions.plugins import Encoder, HashingEncoder, encode_column
from narralytics.operators import corpus as C
from narralytics.operators import topics as T
from narralytics.operators.density import density_topics
from narralytics.session import cut_lineage


@dataclass
class TopicStudy:
    assignments: DataFrame
    terms: DataFrame
    summary: DataFrame
    candidates: DataFrame
    review: DataFrame


def study_topics(comments: DataFrame, ordinal: str, codebook: DataFrame, make_encoder: Callable[[], Encoder] = HashingEncoder,
                 rows: int | None = None, clusters: int = 50, min_size: int = 120, min_topics: int = 5, method: str = "kmeans",
                 min_samples: int = 10, components: int = 5) -> TopicStudy:
    """All long comments are studied unless ``rows`` asks for the first so many. The reviewer fills the blank columns of ``review``; ``select_topics`` then exports the choice.

    ``method`` is ``kmeans`` (``clusters`` of them, small ones are noise) or ``density`` (as many topics as the reduced vectors show, rows outside are noise).
    """
    if method not in ("kmeans", "density"):
        raise ValueError(f"unknown method {method}")
    encode = encode_column(make_encoder)
    sample = C.sequential_sample(comments, ordinal, rows)
    documents = C.long_documents(sample).withColumn("vec", encode(F.col("text")))
    # model fitting reads the encoded sample several times: write it once
    encoded = cut_lineage(documents)
    if method == "kmeans":
        topics = T.cluster_topics(encoded, k=clusters, components=components, min_size=min_size)
    else:
        reduced = T.reduce_dimensions(encoded, "vec", components, "_r").select(F.col(ordinal).cast("long").alias("id"), F.col("_r").alias("vec"))
        found = density_topics(reduced, min_samples, min_size).withColumnRenamed("id", "_id")
        topics = encoded.join(found, F.col(ordinal) == F.col("_id")).drop("_id")
    assigned = cut_lineage(topics)
    terms = T.topic_terms(assigned.where("topic_id <> -1"), min_topics=min_topics)
    representatives = T.representative_rows(assigned.where("topic_id <> -1"), ordinal)
    summary = T.with_cluster_text(T.topic_table(assigned, terms, representatives))
    described = summary.select(F.col("topic_id").alias("cluster_id"), F.col("name").alias("cluster_name"),
                               F.col("count").alias("cluster_count"), encode(F.col("cluster_text")).alias("vec"))
    prototypes = codebook.withColumn("vec", encode(F.col("prototype_text")))
    candidates = T.rank_candidates(described, prototypes)
    return TopicStudy(assigned, terms, summary, candidates, T.review_table(described, candidates, codebook))
