"""Retention: what can be removed for good, decided by chains of anti joins in the order sources, versions, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.operators.statistics import OPEN_STATES


def expired_files(files: DataFrame, cutoff: Column) -> DataFrame:
    """Files deleted before the cutoff."""
    return files.where(F.col("deleted_at") < cutoff)


def collect_versions(versions: DataFrame, files: DataFrame, store_files: DataFrame, items: DataFrame,
                     cutoff: Column) -> DataFrame:
    """Versions to remove: all of expired files, and old ones neither current, nor pinned, nor in flight."""
    gone = expired_files(files, cutoff).select("file_id")
    kept_files = files.join(gone, "file_id", "left_anti")
    current = kept_files.where(F.col("current_version_id").isNotNull()).select(F.col("current_version_id").alias("version_id"))
    pinned = (store_files.join(gone, "file_id", "left_anti").where(F.col("pinned_version_id").isNotNull())
              .select(F.col("pinned_version_id").alias("version_id")))
    flying = items.where(F.col("state").isin(OPEN_STATES) & F.col("version_id").isNotNull()).select("version_id")
    needed = current.unionByName(pinned).unionByName(flying)
    superseded = (versions.where(F.col("created_at") < cutoff).join(gone, "file_id", "left_anti")
                  .join(needed, "version_id", "left_anti"))
    orphaned = versions.join(gone, "file_id", "left_semi")
    return (orphaned.withColumn("reason", F.lit("source deleted"))
            .unionByName(superseded.withColumn("reason", F.lit("superseded"))))


def collect_blobs(blobs: DataFrame, versions: DataFrame, removed: DataFrame, pending: DataFrame,
                  cutoff: Column) -> DataFrame:
    """Old blobs no remaining version uses and no queued or running import waits for.

    ``removed(version_id)`` are the versions just collected, ``pending(workspace_id, sha256)`` the awaited bytes.
    """
    key = ["workspace_id", "sha256"]
    remaining = versions.join(removed.select("version_id"), "version_id", "left_anti").select(*key)
    return (blobs.where(F.col("created_at") < cutoff).join(remaining, key, "left_anti")
            .join(pending.select(*key), key, "left_anti"))


def expired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Open upload sessions past their end; their unverified bytes can go."""
    return sessions.where((F.col("state") == "open") & (F.col("expires_at") < now))


def expired_assets(assets: DataFrame, now: Column) -> DataFrame:
    """Query assets past their end."""
    return assets.where(F.col("expires_at") < now)
