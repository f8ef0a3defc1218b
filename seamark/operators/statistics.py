"""Figures about stores, files, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

OPEN_STATES = ["queued", "running"]
TERMINAL_STATES = ["completed", "completed_with_errors", "failed", "cancelled"]


def store_stats(stores: DataFrame, members: DataFrame, versions: DataFrame, segments: DataFrame, profile_id: str) -> DataFrame:
    """Per live store: files, source bytes, segments, segments by modality (a map); zeros for a store without members."""
    sizes = members.join(versions.select("version_id", "size"), "version_id").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("source_bytes"))
    # count per version first: the join then carries one row per (version, modality)
    per_version = segments.where(F.col("profile_id") == profile_id).groupBy("version_id", "modality").agg(
        F.count(F.lit(1)).alias("n"))
    by = (members.select("store_id", "version_id").join(per_version, "version_id").groupBy("store_id", "modality")
          .agg(F.sum("n").alias("n")).groupBy("store_id").agg(
              F.sum("n").alias("segments"),
              F.map_from_entries(F.sort_array(F.collect_list(F.struct("modality", "n")))).alias("by_modality")))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("files", "source_bytes", "segments")}
    live = stores.where(F.col("deleted_at").isNull()).select("store_id")
    return live.join(sizes, "store_id", "left").join(by, "store_id", "left").withColumns(zero)


def store_activity(stores: DataFrame, jobs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per live store: its jobs by state (a map) and its index revisions with their states, oldest name first; empty where
    there are none. ``jobs(store_id, state)``, ``revisions(store_id, revision_id, profile_id, state)``."""
    by = jobs.groupBy("store_id", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("store_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("jobs_by_state"))
    indexes = revisions.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("revision_id", "profile_id", "state"))).alias("revisions"))
    live = stores.where(F.col("deleted_at").isNull()).select("store_id")
    rows = live.join(by, "store_id", "left").join(indexes, "store_id", "left")
    return rows.withColumns({"jobs_by_state": F.coalesce("jobs_by_state", F.create_map().cast("map<string,bigint>")),
                             "revisions": F.coalesce("revisions", F.array().cast("array<struct<revision_id:string,profile_id:string,state:string>>"))})


def store_summary(stores: DataFrame, members: DataFrame, segments: DataFrame, profile_id: str) -> DataFrame:
    """Per live store: distinct files, segments, ready or empty."""
    per_version = segments.where(F.col("profile_id") == profile_id).groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n"))
    counted = members.join(per_version, "version_id", "left").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("segments"))
    return (stores.where(F.col("deleted_at").isNull()).select("store_id", "name", "kind").join(counted, "store_id", "left")
            .withColumn("files", F.coalesce("files", F.lit(0))).withColumn("segments", F.coalesce("segments", F.lit(0)))
            .withColumn("state", F.when(F.col("segments") > 0, "ready").otherwise("empty")))


def file_status(files: DataFrame, versions: DataFrame, items: DataFrame, segments: DataFrame, store_files: DataFrame,
                stores: DataFrame) -> DataFrame:
    """Per file: status, segments and profiles of the current version, latest failure, live stores."""
    job = items.groupBy("file_id").agg(
        F.count_if(F.col("state").isin(OPEN_STATES)).alias("pending"),
        F.max_by(F.when(F.col("state") == "failed", F.struct("error_code", "error_message")),
                 F.when(F.col("state") == "failed", F.struct("updated_at", "item_id"))).alias("last_error"))
    per_version = segments.groupBy("version_id", "profile_id").agg(F.count(F.lit(1)).alias("n")).groupBy("version_id").agg(
        F.sum("n").alias("segment_count"), F.sort_array(F.collect_list("profile_id")).alias("profiles"))
    live = stores.where(F.col("deleted_at").isNull()).select("store_id")
    held = store_files.join(live, "store_id", "left_semi").groupBy("file_id").agg(
        F.sort_array(F.collect_set("store_id")).alias("stores"))
    current = versions.select(F.col("version_id").alias("current_version_id"), "version_no")
    status = (F.when(F.coalesce("pending", F.lit(0)) > 0, "processing").when(F.col("version_no").isNotNull(), "published")
              .when(F.col("last_error").isNotNull(), "failed").otherwise("pending"))
    return (files.select("file_id", "path", "current_version_id").join(current, "current_version_id", "left")
            .join(job, "file_id", "left").join(held, "file_id", "left")
            .join(per_version.withColumnRenamed("version_id", "current_version_id"), "current_version_id", "left")
            .select("file_id", "path", status.alias("status"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
                    F.coalesce("profiles", F.array().cast("array<string>")).alias("profiles"), "last_error",
                    F.coalesce("stores", F.array().cast("array<string>")).alias("stores")))


def job_counts(items: DataFrame) -> DataFrame:
    """Item counters per job."""
    states = ["queued", "running", "succeeded", "failed", "cancelled"]
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states],
        F.count_if((F.col("state") == "failed") & F.col("retryable")).alias("retryable"))


def finalize_jobs(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """New state of every job from the states of its items; a finished job keeps its state."""
    c = job_counts(items)
    joined = jobs.select("job_id", "state").join(
        c.select("job_id", (F.col("queued") + F.col("running")).alias("open"), F.col("running").alias("busy"),
                 F.col("succeeded").alias("ok"), F.col("failed").alias("bad"), F.col("cancelled").alias("cx")),
        "job_id", "left").fillna(0, ["open", "busy", "ok", "bad", "cx"])
    state = (F.when(F.col("state").isin(TERMINAL_STATES), F.col("state"))
             .when((F.col("open") > 0) & (F.col("state") == "queued") & ((F.col("busy") > 0) | (F.col("ok") + F.col("bad") > 0)),
                   "running")
             .when(F.col("open") > 0, F.col("state"))
             .when((F.col("state") == "cancel_requested") | (F.col("cx") > 0), "cancelled")
             .when(F.col("bad") == 0, "completed").when(F.col("ok") > 0, "completed_with_errors").otherwise("failed"))
    return joined.select("job_id", F.col("state").alias("old_state"), state.alias("state"))


def gauges(workspaces: DataFrame, stores: DataFrame, segments: DataFrame, blobs: DataFrame, jobs: DataFrame,
           items: DataFrame) -> DataFrame:
    """Operational gauges as (name, labels, value)."""
    def counted(df: DataFrame, name: str, label: str | None = None) -> DataFrame:
        if label is None:
            return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
                F.lit(name).alias("name"), F.lit("").alias("labels"), "value")
        text = F.concat(F.lit(label + '="'), F.col(label), F.lit('"'))
        return df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit(name).alias("name"), text.alias("labels"), "value")

    size = blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("blob_bytes").alias("name"), F.lit("").alias("labels"), "value")
    return (counted(workspaces, "workspaces")
            .unionByName(counted(stores.where(F.col("deleted_at").isNull()), "stores", "kind"))
            .unionByName(counted(segments, "segments")).unionByName(size)
            .unionByName(counted(jobs, "jobs", "state")).unionByName(counted(items, "job_items", "state")))


def deletion_preview(shared: DataFrame) -> DataFrame:
    """Counts for a store about to be deleted, from :func:`shared_sources` rows."""
    return shared.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("memberships"), F.count_if("shared").alias("shared_sources"),
        F.count_if(~F.col("shared")).alias("deleted_if_unshared"))


def profile_aliases(aliases: DataFrame) -> DataFrame:
    """Purpose to alias map per profile; ``aliases(alias, profile_id, purpose)`` has one alias per purpose."""
    return aliases.groupBy("profile_id").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("purpose", "alias")))).alias("aliases"))
