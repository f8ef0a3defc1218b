"""Mirror of an external manifest into a store: what is new, changed, unchanged, removed or skipped."""

from pyspark.sql import DataFrame, functions as F

from seamark.functions.metadata import literal
from seamark.sources.files import media_type

CONNECTOR_KEY = "connector_id"


def mirror_manifest(manifest: DataFrame, members: DataFrame, connector_id: str) -> DataFrame:
    """Plan for ``manifest(path, sha256)`` against ``members(file_id, path, sha256, metadata)``.

    Only members carrying this connector's tag can be removed. Unsafe or unsupported entries are skipped rows.
    """
    path = F.col("path")
    unsafe = ((F.coalesce(path, F.lit("")) == "") | path.startswith("/") | path.contains("\\")
              | F.array_contains(F.split(path, "/"), "..") | media_type(path).isNull())
    # one entry per path: a path listed twice counts once
    entries = manifest.groupBy("path").agg(F.max("sha256").alias("new_sha")).withColumn("skipped", unsafe)
    current = members.groupBy("path").agg(
        F.max("file_id").alias("file_id"), F.max_by("sha256", "file_id").alias("old_sha"),
        F.max_by(F.col("metadata")[CONNECTOR_KEY], F.col("file_id")).alias("tag"))
    good = entries.where(~F.col("skipped")).select("path", "new_sha")
    both = current.join(good, "path", "full_outer")
    action = (F.when(F.col("new_sha").isNull() & (F.col("tag") == literal(connector_id)), "removed")
              .when(F.col("new_sha").isNull(), "kept")
              .when(F.col("old_sha").isNull(), "new")
              .when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("changed"))
    planned = both.select("path", "file_id", "old_sha", "new_sha", action.alias("action"))
    none = F.lit(None).cast("string")
    skipped = entries.where("skipped").select("path", none.alias("file_id"), none.alias("old_sha"), "new_sha",
                                              F.lit("skipped").alias("action"))
    return planned.unionByName(skipped)


def mirror_counts(plan: DataFrame) -> DataFrame:
    """Totals of a mirror plan by action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
