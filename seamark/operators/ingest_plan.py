"""What an ingest of delivered files will do, decided on narrow tables before a byte is read or a row written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamark.operators.embedding import SINGLE_PREPARATION, needed_profiles
from seamark.operators.lifecycle import resolve_versions

PLACE = ["workspace_id", "store_id", "path"]


def fold_deliveries(arrived: DataFrame, seen: DataFrame) -> DataFrame:
    """``arrived`` with ``fold``: publish, repeated or superseded.

    ``arrived(item_id, workspace_id, store_id, path, sha256, modified_at, ...)`` may hold a place several times, in any
    order; ``seen(workspace_id, store_id, path, modified_at)`` is the newest revision published so far of each place. The newest
    delivery of a place is published (of equally new ones the one with the largest hash, then item), unless a newer revision
    already was; others with its bytes are repeated, the rest superseded. One row per place is compared, made by a combined
    maximum, so a place that is delivered over and over is no hot group.
    """
    newest = arrived.groupBy(*PLACE).agg(F.max(F.struct("modified_at", "sha256", "item_id")).alias("__newest"))
    before = seen.groupBy(*PLACE).agg(F.max("modified_at").alias("__seen"))
    late = F.coalesce(F.col("__newest.modified_at") < F.col("__seen"), F.lit(False))
    fold = (F.when(late, "superseded").when(F.col("item_id") == F.col("__newest.item_id"), "publish")
            .when(F.col("sha256") == F.col("__newest.sha256"), "repeated").otherwise("superseded"))
    return arrived.join(newest.join(before, PLACE, "left"), PLACE).withColumn("fold", fold).drop("__newest", "__seen")


def preparation_twins(profiles: DataFrame) -> DataFrame:
    """(profile_id, source_profile, prep_key): profiles whose vectors of one kind of medium are the same, by
    ``profiles(profile_id, model, revision, dtype, preparation MAP)``; a few rows."""
    entries = profiles.select("profile_id", "model", "revision", "dtype", F.explode("preparation").alias("prep_key", "entry"))
    source = entries.withColumnRenamed("profile_id", "source_profile")
    return entries.join(source, ["model", "revision", "dtype", "prep_key", "entry"]).where("profile_id <> source_profile").select(
        "profile_id", "source_profile", "prep_key")


def vector_work(versions: DataFrame, known: DataFrame, needed: DataFrame, segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """(version_id, profile_id, how): vectors that the versions ``versions(version_id, file_id, sha256, filename, media_type)``
    lack for the profiles ``needed(file_id, profile_id)``: copy (same bytes and name have them), twin (the same version has
    them under a profile that makes the same) or embed. ``known`` are the versions already in the catalogue."""
    have = segments.select("version_id", "profile_id").distinct()
    lacking = versions.join(needed, "file_id").join(have, ["version_id", "profile_id"], "left_anti")
    copies = known.join(have, "version_id").select("sha256", "filename", "profile_id").distinct().withColumn("copied", F.lit(True))
    key = F.lit(None).cast("string")
    for kind, name in SINGLE_PREPARATION.items():
        key = F.when(F.col("media_type") == kind, name).otherwise(key)
    same = have.withColumnRenamed("profile_id", "source_profile").join(F.broadcast(preparation_twins(profiles)), "source_profile").select(
        "version_id", "profile_id", "prep_key").distinct().withColumn("twin", F.lit(True))
    found = lacking.withColumn("prep_key", key).join(copies, ["sha256", "filename", "profile_id"], "left").join(
        same, ["version_id", "profile_id", "prep_key"], "left")
    return found.select("version_id", "profile_id", F.when(F.col("copied"), "copy").when(F.col("twin"), "twin").otherwise("embed").alias("how"))


def plan_ingest(arrived: DataFrame, seen: DataFrame, files: DataFrame, versions: DataFrame, store_files: DataFrame, stores: DataFrame,
                revisions: DataFrame, segments: DataFrame, profiles: DataFrame, refused: DataFrame) -> DataFrame:
    """One row per delivery, as its job item will start: (item_id, path, action, file_id, version_id, version_no, copies, embeds,
    state, retryable, error_code).

    ``arrived(item_id, workspace_id, store_id, path, sha256, size, media_type, modified_at, reason)`` are gated deliveries
    (``reason``: why one is not taken). Repeated and superseded deliveries end at once; the others get file and version,
    and the vectors they lack are copied where they exist. ``refused(workspace_id, index_refused)``: a workspace without
    indexing allowance may copy but not embed. Nothing is read but narrow columns, and nothing is written.
    """
    rejected = arrived.where("reason is not null").select("item_id", "path", F.lit("rejected").alias("action"), F.lit("failed").alias("state"),
                                                          F.col("reason").alias("error_code"))
    folded = fold_deliveries(arrived.where("reason is null"), seen)
    settled = folded.where("fold <> 'publish'").select("item_id", "path", F.col("fold").alias("action"), F.lit("succeeded").alias("state"))
    going = folded.where("fold = 'publish'")
    incoming = going.select("item_id", "store_id", F.lit(None).cast("string").alias("file_id"), F.col("item_id").alias("upload_id"), "path",
                            "sha256", "size", "media_type")
    planned = resolve_versions(incoming, files, versions, store_files)
    made = planned.where("version_id is not null")
    held = made.select("store_id", "file_id").unionByName(store_files.select("store_id", "file_id").join(
        made.select("file_id"), "file_id", "left_semi").select("store_id", "file_id"))
    needed = needed_profiles(made.select("file_id").distinct(), held, stores, revisions)
    name = F.element_at(F.split("path", "/"), -1)
    known = versions.select("version_id", "sha256", "filename")
    current = made.select("version_id", "file_id", "sha256", name.alias("filename"), "media_type").dropDuplicates(["version_id"])
    work = vector_work(current, known, needed, segments, profiles).groupBy("version_id").agg(
        F.count_if(F.col("how") != "embed").alias("copies"), F.count_if(F.col("how") == "embed").alias("embeds"))
    rows = planned.join(work, "version_id", "left").join(going.select("item_id", "workspace_id"), "item_id").join(
        F.broadcast(refused.select("workspace_id", "index_refused")), "workspace_id", "left")
    embeds = F.coalesce("embeds", F.lit(0))
    over = (embeds > 0) & F.coalesce("index_refused", F.lit(False))
    gone = F.col("action") == "NOT_FOUND"
    decided = rows.select(
        "item_id", "path", "action", "file_id", "version_id", "version_no", F.coalesce("copies", F.lit(0)).alias("copies"), embeds.alias("embeds"),
        F.when(gone | over, "failed").when(embeds > 0, "queued").otherwise("succeeded").alias("state"), (over & ~gone).alias("retryable"),
        F.when(gone, "NOT_FOUND").when(over, "QUOTA_EXCEEDED").alias("error_code"))
    rest = settled.unionByName(rejected, allowMissingColumns=True).withColumns({
        "copies": F.lit(0).cast("bigint"), "embeds": F.lit(0).cast("bigint"), "retryable": F.lit(False)})
    return decided.unionByName(rest, allowMissingColumns=True)
