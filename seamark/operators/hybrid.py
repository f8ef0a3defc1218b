"""Fused and balanced rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.functions.vectors import cosine_distance
from seamark.operators.keyword import search_keyword
from seamark.operators.vector_search import search_exact
from seamark.session import bounded

RRF_K = 60  # fixed value
MAX_HITS = 1_000_000  # candidates of all queries that may be broadcast
MODALITIES = ("text", "image", "audio", "video")  # fixed values


def depth_of(k: int) -> int:
    """Candidates taken from each ranking before fusion."""
    return max(4 * k, 40)


def search_hybrid(queries: DataFrame, segments: DataFrame, k: int, postings: DataFrame, modalities: Sequence[str] | None = None,
                  vector_search: Callable[[DataFrame, DataFrame, int], DataFrame] = search_exact) -> DataFrame:
    """Reciprocal rank fusion of vector and identifier rankings: (query_id, segment_id, distance, rrf, keyword_rank,
    vector_rank, rank). ``segments`` are the eligible ones of the store and ``postings`` theirs in a stored index; ``modalities``
    limits both rankings only. A segment or question without a vector has no distance and comes after those that tie with it."""
    n = depth_of(k)
    allowed = segments if modalities is None else segments.where(F.col("modality").isin(list(modalities)))
    by_vector = vector_search(queries, allowed, n).select("query_id", "segment_id", F.col("rank").alias("rk"),
                                                          F.lit("vec").alias("src"))
    by_word = search_keyword(queries, segments, postings, n, allowed if modalities is not None else None).select(
        "query_id", "segment_id", F.col("rank").alias("rk"), F.lit("kw").alias("src"))
    fused = by_vector.unionByName(by_word).groupBy("query_id", "segment_id").agg(
        F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rk"))).alias("rrf"),
        F.min(F.when(F.col("src") == "kw", F.col("rk"))).alias("keyword_rank"),
        F.min(F.when(F.col("src") == "vec", F.col("rk"))).alias("vector_rank"))
    # at most 2n rows per query: with few enough queries the embeddings are looked up without being shuffled
    located = (bounded(fused, MAX_HITS).join(allowed.select("segment_id", F.col("embedding").alias("__s")), "segment_id")
               .join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
               .withColumn("distance", cosine_distance(F.col("__s"), F.col("__q"))).drop("__s", "__q"))
    order = W.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.asc_nulls_last("distance"), "segment_id")
    return located.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def interleave(per_modality: DataFrame, k: int) -> DataFrame:
    """Merge rankings made inside each modality: (modality_rank, distance), at most k per query."""
    order = W.partitionBy("query_id").orderBy("modality_rank", F.asc_nulls_last("distance"), "segment_id")
    return per_modality.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_balanced(queries: DataFrame, segments: DataFrame, k: int, modalities: Sequence[str] = MODALITIES,
                    postings: DataFrame | None = None) -> DataFrame:
    """Rank inside each modality in one scan, then interleave, so no modality hides another. With the ``postings`` of a
    stored index the text modality is ranked by the hybrid order of the queries' words."""
    shape = ["query_id", "segment_id", "modality", "distance", "modality_rank"]
    plain = [m for m in modalities if not (postings is not None and m == "text")]
    ranked = (search_exact(queries, segments.where(F.col("modality").isin(plain)), k, group="modality")
              .withColumnRenamed("rank", "modality_rank").select(*shape))
    if postings is not None and "text" in modalities:
        words = search_hybrid(queries, segments, k, postings, ["text"]).withColumn("modality", F.lit("text"))
        ranked = ranked.unionByName(words.withColumnRenamed("rank", "modality_rank").select(*shape))
    return interleave(ranked, k)
