"""Versions, publication, metadata changes, reindexing, deletion, replay, retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.functions.ids import uuid5
from seamark.functions.metadata import MAX_METADATA_CHARS, compact_chars, merge_patch
from seamark.operators.embedding import missing_vectors
from seamark.operators.statistics import TERMINAL_STATES

FILE_NAMESPACE = "0b0c2b5e-55a5-4c4b-9d2e-2c8f0f6f7a11"  # name space of ids for new files and versions


def resolve_versions(incoming: DataFrame, files: DataFrame, versions: DataFrame, store_files: DataFrame,
                     earlier: DataFrame | None = None) -> DataFrame:
    """Decide file and version of every incoming item.

    ``incoming(item_id, store_id, file_id, upload_id, path, sha256, size, media_type)``; ``earlier(upload_id, file_id)``
    lists files already made from an upload. The file is the one named, else the one of the same upload, else the one at
    the same path in the store, else a new one. Unchanged bytes keep the published version, others get the next number;
    several items of one batch for the same file are numbered in item order.
    """
    alive = files.where(F.col("deleted_at").isNull())
    at_path = (store_files.select("store_id", "file_id").join(alive.select("file_id", "path"), "file_id")
               .groupBy("store_id", "path").agg(F.min("file_id").alias("path_file")))
    rows = incoming.join(at_path, ["store_id", "path"], "left")
    if earlier is not None:
        known = (earlier.join(alive.select("file_id"), "file_id", "left_semi").groupBy("upload_id")
                 .agg(F.min("file_id").alias("upload_file")))
        rows = rows.join(known, "upload_id", "left")
    else:
        rows = rows.withColumn("upload_file", F.lit(None).cast("string"))
    fresh = uuid5(F.concat_ws("|", F.lit("file"), "store_id", "path"), FILE_NAMESPACE)
    rows = rows.withColumn("target", F.coalesce("file_id", "upload_file", "path_file", fresh)).withColumn(
        "is_new_file", F.coalesce("file_id", "upload_file", "path_file").isNull())
    latest = versions.groupBy("file_id").agg(F.max("version_no").alias("last_no"))
    current = (alive.select(F.col("file_id").alias("target"), "current_version_id")
               .join(versions.select(F.col("version_id").alias("current_version_id"), F.col("sha256").alias("current_sha")),
                     "current_version_id", "left").withColumn("found", F.lit(True)))
    rows = (rows.drop("file_id").join(current, "target", "left")
            .join(latest.withColumnRenamed("file_id", "target"), "target", "left"))
    unchanged = F.coalesce(F.col("current_sha") == F.col("sha256"), F.lit(False))
    gone = ~F.col("is_new_file") & F.col("found").isNull()
    rows = rows.withColumn("action", F.when(gone, "NOT_FOUND").when(unchanged, "reuse")
                           .when(F.col("is_new_file"), "new_file").otherwise("new_version"))
    # equal bytes of one batch for one file share a version; different bytes get consecutive numbers
    numbered = rows.where(F.col("action").isin("new_file", "new_version")).groupBy("target", "sha256").agg(
        F.min("item_id").alias("first_item"))
    order = numbered.withColumn("step", F.row_number().over(W.partitionBy("target").orderBy("first_item", "sha256")))
    rows = rows.join(order.select("target", "sha256", "step"), ["target", "sha256"], "left")
    number = F.when(F.col("step").isNotNull(), F.coalesce("last_no", F.lit(0)) + F.col("step")).cast("int")
    made = uuid5(F.concat_ws("|", F.lit("version"), "target", number.cast("string"), "sha256"), FILE_NAMESPACE)
    return rows.select("item_id", "store_id", F.col("target").alias("file_id"), "path", "sha256", "size", "media_type",
                       "action", number.alias("version_no"),
                       F.when(F.col("action") == "reuse", F.col("current_version_id"))
                       .when(F.col("step").isNotNull(), made).alias("version_id"))


def publish(files: DataFrame, versions: DataFrame, batch: DataFrame) -> DataFrame:
    """Files with their pointers after publishing ``batch(file_id, version_id)``.

    The highest version of the batch becomes current unless the current one is newer; deleted files stay as they are.
    """
    numbers = versions.select("version_id", "version_no")
    newest = batch.join(numbers, "version_id").groupBy("file_id").agg(
        F.max(F.struct("version_no", "version_id")).alias("n"))
    joined = files.join(newest, "file_id", "left").join(
        numbers.select(F.col("version_id").alias("current_version_id"), F.col("version_no").alias("current_no")),
        "current_version_id", "left")
    takes = (F.col("n").isNotNull() & F.col("deleted_at").isNull()
             & (F.col("current_no").isNull() | (F.col("n.version_no") >= F.col("current_no"))))
    return joined.withColumn("current_version_id", F.when(takes, F.col("n.version_id"))
                             .otherwise(F.col("current_version_id"))).select(*files.columns)


def publish_members(store_files: DataFrame, batch: DataFrame) -> DataFrame:
    """Membership after publishing: existing rows stay, new (store, file) pairs are added without a pin."""
    new = (batch.where(F.col("store_id").isNotNull()).select("store_id", "file_id").distinct()
           .join(store_files.select("store_id", "file_id"), ["store_id", "file_id"], "left_anti"))
    return store_files.unionByName(new, allowMissingColumns=True)


def replace_content(file_id: str, new_bytes: DataFrame, files: DataFrame, versions: DataFrame,
                    store_files: DataFrame) -> DataFrame:
    """Version decision for new content of one file; the old version stays visible until :func:`publish`."""
    incoming = new_bytes.withColumn("file_id", F.lit(file_id)).withColumn("store_id", F.lit(None).cast("string"))
    return resolve_versions(incoming, files, versions, store_files)


def patch_metadata(files: DataFrame, patches: DataFrame, embedded_fields: DataFrame | None = None) -> DataFrame:
    """Apply ``patches(file_id, patch MAP)``: null removes a key; more than 16 KiB is refused and leaves the file alone.

    ``embedded_fields(file_id, fields ARRAY)``: metadata that is part of the model input; touching one asks for
    reprocessing.
    """
    rows = files.join(patches, "file_id").withColumn("merged", merge_patch(F.col("metadata"), F.col("patch")))
    too_big = compact_chars(F.col("merged")) > MAX_METADATA_CHARS
    if embedded_fields is None:
        touched = F.lit(False)
    else:
        rows = rows.join(embedded_fields, "file_id", "left")
        touched = F.coalesce(F.arrays_overlap(F.map_keys("patch"), F.col("fields")), F.lit(False))
    return rows.select("file_id", F.when(too_big, F.col("metadata")).otherwise(F.col("merged")).alias("metadata"),
                       F.when(too_big, "INVALID_REQUEST").alias("error_code"),
                       (touched & ~too_big).alias("reprocessing_required"))


def reindex_plan(members: DataFrame, segments: DataFrame, versions: DataFrame, profile_id: str) -> DataFrame:
    """Versions of a store that lack vectors for a profile, each with how it can be served: copy by content or embed."""
    todo = missing_vectors(members.select("file_id", "version_id"), segments, profile_id)
    done = segments.where(F.col("profile_id") == profile_id).select("version_id").distinct()
    content = versions.join(done, "version_id", "left_semi").groupBy("sha256", "filename").agg(F.lit(True).alias("copy"))
    return (todo.join(versions.select("version_id", "sha256", "filename"), "version_id")
            .join(content, ["sha256", "filename"], "left")
            .select("file_id", "version_id", F.when(F.col("copy"), "copy").otherwise("embed").alias("action")))


def reindex_state(revisions: DataFrame, items: DataFrame, revision_id: str) -> DataFrame:
    """Revisions after a reindex run: building becomes ready if no item failed, else failed."""
    bad = items.where(F.col("state") != "succeeded").agg(F.count(F.lit(1)).alias("n")).scalar()
    mine = (F.col("revision_id") == revision_id) & (F.col("state") == "building")
    return revisions.withColumn("state", F.when(mine, F.when(bad == 0, "ready").otherwise("failed"))
                                .otherwise(F.col("state")))


def promotable(revisions: DataFrame, members: DataFrame, segments: DataFrame) -> DataFrame:
    """Per revision: members without vectors of its profile, and whether it can be promoted (ready and complete)."""
    have = segments.select("version_id", "profile_id").distinct().withColumn("have", F.lit(1))
    wanted = revisions.select("revision_id", "store_id", "profile_id", "state").join(
        members.select("store_id", "version_id"), "store_id", "left")
    checked = wanted.join(have, ["version_id", "profile_id"], "left").groupBy("revision_id", "store_id", "state").agg(
        F.count_if(F.col("version_id").isNotNull() & F.col("have").isNull()).alias("missing"))
    return checked.withColumn("verdict", F.when(F.col("state") == "active", "active")
                              .when(F.col("state") != "ready", "INDEX_NOT_READY")
                              .when(F.col("missing") > 0, "INDEX_INCOMPLETE").otherwise("promotable"))


def promote(revisions: DataFrame, stores: DataFrame, verdicts: DataFrame,
            revision_ids: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions, stores, outcomes) with the given revisions active where their verdict allows it.

    ``verdicts`` are rows of :func:`promotable`; name one revision per store. The revision before stays ready, so promoting
    it again rolls back. A revision that is not ready or not complete changes nothing, and its outcome is the code.
    """
    asked = verdicts.where(F.col("revision_id").isin(revision_ids)).select("revision_id", "store_id", "verdict")
    outcomes = asked.select("revision_id", F.when(F.col("verdict").isin("promotable", "active"), "active")
                            .otherwise(F.col("verdict")).alias("outcome"))
    target = asked.where("verdict = 'promotable'").select("store_id", F.col("revision_id").alias("new_revision"))
    joined = revisions.join(target, "store_id", "left")
    state = (F.when(F.col("revision_id") == F.col("new_revision"), "active")
             .when(F.col("new_revision").isNotNull() & (F.col("state") == "active"), "ready").otherwise(F.col("state")))
    new_revisions = joined.withColumn("state", state).select(*revisions.columns)
    new_stores = stores.join(target, "store_id", "left").withColumn(
        "active_revision_id", F.coalesce("new_revision", "active_revision_id")).select(*stores.columns)
    return new_revisions, new_stores, outcomes


def unshared_sources(store_files: DataFrame, stores: DataFrame, files: DataFrame, store_id: str) -> DataFrame:
    """Live sources of a store that no other live store holds."""
    alive = stores.where(F.col("deleted_at").isNull() & (F.col("store_id") != store_id)).select("store_id")
    elsewhere = store_files.join(alive, "store_id", "left_semi").select("file_id")
    mine = store_files.where(F.col("store_id") == store_id).select("file_id")
    return (files.where(F.col("deleted_at").isNull()).select("file_id", "path").join(mine, "file_id", "left_semi")
            .join(elsewhere, "file_id", "left_anti"))


def delete_store(stores: DataFrame, store_files: DataFrame, files: DataFrame, revisions: DataFrame, store_id: str,
                 at: Column, sources: str = "keep") -> dict[str, DataFrame]:
    """Tables after deleting a store; ``sources='unshared'`` also deletes the files only it holds."""
    if sources not in ("keep", "unshared"):
        raise ValueError("sources accepts keep, unshared")
    new_files = files
    if sources == "unshared":
        only_here = unshared_sources(store_files, stores, files, store_id).select("file_id")
        new_files = delete_files(files, only_here, at)
    mine = F.col("store_id") == store_id
    return {
        "stores": stores.withColumn("deleted_at", F.when(mine, F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))),
        "store_files": store_files.where(~mine),
        "files": new_files,
        "revisions": revisions.withColumn("state", F.when(mine, "retired").otherwise(F.col("state"))),
    }


def delete_files(files: DataFrame, doomed: DataFrame, at: Column) -> DataFrame:
    """Files with ``deleted_at`` set for ``doomed(file_id)``; every store, also a snapshot, stops showing them."""
    marks = doomed.select("file_id").distinct().withColumn("__gone", F.lit(True))
    return files.join(marks, "file_id", "left").withColumn(
        "deleted_at", F.when(F.col("__gone"), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))
    ).select(*files.columns)


def replay_ledger(files: DataFrame, stores: DataFrame, store_files: DataFrame, ledger: DataFrame,
                  since: Column) -> dict[str, DataFrame]:
    """Tables after re-applying ledger entries newer than a backup; a deletion time already set is kept."""
    newer = ledger.where(F.col("at") > since)
    single = newer.where("kind = 'file.delete'").select(F.col("id").alias("file_id"), "at")
    listed = newer.select(F.explode("file_ids").alias("file_id"), "at")
    gone_files = single.unionByName(listed).groupBy("file_id").agg(F.min("at").alias("__at"))
    gone_stores = newer.where("kind = 'store.delete'").groupBy(F.col("id").alias("store_id")).agg(F.min("at").alias("__at"))

    def mark(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
        return rows.join(gone, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", "__at")).select(*rows.columns)

    return {"files": mark(files, gone_files, "file_id"), "stores": mark(stores, gone_stores, "store_id"),
            "store_files": store_files.join(gone_stores.select("store_id"), "store_id", "left_anti")}


def retry_plan(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Retryable failed items of finished jobs, with the id of the new job that runs them again."""
    done = jobs.where(F.col("state").isin(TERMINAL_STATES)).select("job_id", "kind")
    failed = items.where((F.col("state") == "failed") & F.col("retryable"))
    return failed.join(done, "job_id").select(
        uuid5(F.concat_ws("|", F.lit("retry"), "job_id"), FILE_NAMESPACE).alias("new_job_id"),
        F.col("job_id").alias("retry_of"), "kind", "item_id", "path", "file_id", "version_id")


def request_hash(columns: Sequence[str]) -> Column:
    """Digest of a request body."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def check_replay(requests: DataFrame, body: Sequence[str]) -> DataFrame:
    """Per idempotency key of ``requests(idem_key, at, request_id, <body>)``: the first request, repeats, conflicts.

    A repeat with the body of the first request is answered with its result; any other body is a conflict.
    """
    hashed = requests.withColumn("hash", request_hash(body))
    per_body = hashed.groupBy("idem_key", "hash").agg(F.min(F.struct("at", "request_id")).alias("first"),
                                                      F.count(F.lit(1)).alias("n"))
    return per_body.groupBy("idem_key").agg(
        F.min("first").alias("f"), F.sum("n").alias("requests"), F.min_by("n", "first").alias("same")
    ).select("idem_key", F.col("f.request_id").alias("request_id"), (F.col("same") - 1).alias("replayed"),
             (F.col("requests") - F.col("same")).alias("conflicts"))
