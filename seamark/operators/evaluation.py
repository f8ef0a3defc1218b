"""Retrieval evaluation: hits, answers, cross-modal accuracy, recall, run comparison, export checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamark.functions.vectors import norm

MARGIN = 0.01  # fixed value: a run may lose this much before it counts as worse


def first_ranks(results: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, first): rank of the expected path in ``results(query_id, rank, path)``, null if not in the top k."""
    hits = results.where(F.col("rank") <= k).join(labels.select("query_id", F.col("expected_path").alias("path")),
                                                  ["query_id", "path"])
    best = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    return labels.select("query_id").join(best, "query_id", "left")


def eval_hits(results: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row: queries, hit@k, mean reciprocal rank."""
    return first_ranks(results, labels, k).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_at_k"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def eval_answers(results: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: queries, share answered by the first and by the first three passages of
    ``results(query_id, rank, path, content)``; ``facts(query_id, fact, path_prefix)``."""
    rows = facts.join(results.where("rank <= 3"), "query_id", "left")
    right = F.coalesce(F.contains("content", F.col("fact")) & F.startswith("path", F.coalesce("path_prefix", F.lit(""))),
                       F.lit(False))
    each = rows.groupBy("query_id").agg(F.max(right & (F.col("rank") == 1)).alias("one"), F.max(right).alias("three"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("one").cast("int")).alias("answer_at_1"),
                    F.avg(F.col("three").cast("int")).alias("answer_at_3"))


def eval_cross_modal(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Top-1 accuracy by (query modality, result modality) of ``results(query_id, modality, rank, topic)``."""
    top = results.where("rank = 1").join(labels.select("query_id", "query_modality", "expected_topic"), "query_id")
    return top.groupBy("query_modality", F.col("modality").alias("result_modality")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg((F.col("topic") == F.col("expected_topic")).cast("int")).alias("top1"))


def eval_recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact top k that the approximate top k holds."""
    want = exact.where(F.col("rank") <= k).select("query_id", "segment_id")
    have = approximate.where(F.col("rank") <= k).select("query_id", "segment_id").withColumn("found", F.lit(1))
    return want.join(have, ["query_id", "segment_id"], "left").groupBy("query_id").agg(
        (F.count("found") / F.count(F.lit(1))).alias("recall"))


def compare_runs(a: DataFrame, b: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row from two :func:`eval_hits` rows: differences and whether run b is no worse than run a."""
    return b.select(a.select("hit_at_k").scalar().alias("hit_a"), F.col("hit_at_k").alias("hit_b"),
                    a.select("mrr").scalar().alias("mrr_a"), F.col("mrr").alias("mrr_b")).withColumn(
        "no_regression", F.col("mrr_b") >= F.col("mrr_a") - margin)


def check_export(export: DataFrame, expected: DataFrame) -> DataFrame:
    """Per store: exported lines, lines expected by ``expected(store_id, segments)``, vectors off unit length, sources
    without their ids."""
    off = F.abs(norm(F.col("embedding")) - 1) >= 1e-4
    bare = F.col("source.file_id").isNull() | F.col("source.version_id").isNull() | F.col("source.sha256").isNull()
    lines = export.groupBy("store_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(off).alias("off_norm"),
                                           F.count_if(bare).alias("without_source"))
    return lines.join(expected.select("store_id", F.col("segments").alias("expected_lines")), "store_id", "left")
