"""Continuous ingest: every micro-batch of new files is gated, prepared, embedded and published as a whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seamark.functions.vectors import vector_error
from seamark.operators.embedding import Embedder, embed, embed_usage, reuse_by_content
from seamark.operators.ingest_plan import fold_deliveries
from seamark.operators.lifecycle import publish, publish_members, resolve_versions
from seamark.operators.prepare import (AUDIO_TYPES, BLOCK_TYPES, IMAGE_TYPES, PAGE_TYPES, TEXT_TYPES, VIDEO_TYPES, check_budget,
                                       model_inputs, prepare, with_ordinals)
from seamark.profiles import Profile
from seamark.session import bounded, cut_lineage
from seamark.sources.catalog import Catalog
from seamark.sources.files import gated


MAX_VERSIONS = 100_000  # versions of a batch, without their bytes, that may be broadcast
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of files appearing below a folder: path, size, modified_at, content."""
    raw = (spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files).load(folder))
    base = folder.rstrip("/") + "/"
    return raw.select(F.element_at(F.split("path", F.lit(r"\Q" + base + r"\E"), 2), -1).alias("path"),
                      F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def ingest_batch(catalog: Catalog, arrived: DataFrame, workspace_id: str, store_id: str, profile: Profile,
                 make_embedder: Callable[[], Embedder] | dict[str, Callable[[], Embedder]],
                 decode: Callable[[DataFrame], dict[str, DataFrame]] | None = None, job_id: str = "ingest") -> DataFrame:
    """Ingest one set of files and return their outcomes (path, outcome).

    ``arrived(path, size, content)`` may have ``modified_at``. Deliveries of one path are folded first: the newest revision is
    published, unless a newer one already was; others are ``repeated`` or ``superseded``. Everything is decided on narrow
    rows, stored once; bytes are then read where they are, for the versions to prepare alone. Vectors are checked before
    they are published; every delivery leaves a job item, every embedding its usage with an idempotency key.

    ``make_embedder`` serves text, or is one per modality. ``decode`` turns (version_id, media_type, content) into the
    tables ``pages``, ``blocks``, ``media`` and ``transcript`` of :func:`prepare`. What no decoder or no embedder serves
    ends as FORMAT_UNSUPPORTED and is not published.

    Every id comes from content and place, and rows already in the catalogue are left out of each append; so a batch
    that is delivered again after a crash adds nothing. The file pointers are flipped last: readers see the old or the
    new complete version.
    """
    ws = F.lit(workspace_id)
    files, versions = catalog.read("files", workspace_id), catalog.read("file_versions", workspace_id)
    members, segments = catalog.read("store_files", workspace_id), catalog.read("segments", workspace_id)
    when = F.col("modified_at").cast("timestamp") if "modified_at" in arrived.columns else F.current_timestamp()
    gate = gated(arrived.withColumn("modified_at", when)).withColumn("sha256", F.sha2("content", 256))
    checked = cut_lineage(gate.select(
        F.concat_ws("|", F.lit(store_id), "path", "sha256").alias("item_id"), ws.alias("workspace_id"), F.lit(store_id).alias("store_id"), "path",
        "sha256", "size", "media_type", "modified_at", "reason"))
    each = checked.groupBy("item_id", "workspace_id", "store_id", "path", "sha256", "size", "media_type", "reason").agg(
        F.max("modified_at").alias("modified_at"), F.count("*").alias("times"))
    folded = fold_deliveries(each.where("reason is null"), catalog.read("deliveries", workspace_id))
    items = folded.where("fold = 'publish'").select(
        "item_id", "store_id", F.lit(None).cast("string").alias("file_id"), F.col("item_id").alias("upload_id"), "path", "sha256", "size", "media_type")
    plan = cut_lineage(resolve_versions(items, files, versions, members))
    made = plan.where(F.col("action").isin("new_file", "new_version")).dropDuplicates(["version_id"])
    name = F.element_at(F.split("path", "/"), -1)
    new_versions = cut_lineage(made.select(
        ws.alias("workspace_id"), "version_id", "file_id", "version_no", "sha256", "size", name.alias("filename"),
        "media_type", F.current_timestamp().alias("created_at")))

    copied = reuse_by_content(new_versions.select("version_id"), versions.unionByName(new_versions), segments,
                              profile.profile_id)
    todo = new_versions.join(copied.select("version_id"), "version_id", "left_anti")
    # the versions to prepare are few columns: with few enough of them (counted) no byte is shuffled
    wanted = bounded(todo.join(plan.select("version_id", "path"), "version_id"), MAX_VERSIONS)
    bodies = gate.where("reason is null").select("path", "sha256", "content").join(wanted, ["path", "sha256"])
    if not each.where("times > 1").isEmpty():
        bodies = bodies.dropDuplicates(["version_id"])
    embedders = make_embedder if isinstance(make_embedder, dict) else {"text": make_embedder}
    sources = bodies.select("version_id", "media_type", "content")
    parts = decode(sources) if decode else {}
    read = [*TEXT_TYPES, *IMAGE_TYPES, *(PAGE_TYPES if "pages" in parts else []), *(BLOCK_TYPES if "blocks" in parts else []),
            *(AUDIO_TYPES + VIDEO_TYPES if "media" in parts else [])]
    cut, failed = prepare(sources.where(F.col("media_type").isin(read)), profile, **parts)
    unread = sources.where(~F.coalesce(F.col("media_type").isin(read), F.lit(False))).select(
        "version_id", F.lit("FORMAT_UNSUPPORTED").alias("error_code"))
    inputs = check_budget(model_inputs(with_ordinals(cut, profile.profile_id), new_versions, profile),
                          limit=profile.max_tokens)
    unserved = F.when(~F.col("modality").isin(sorted(embedders)), F.lit("FORMAT_UNSUPPORTED"))
    over = inputs.select("version_id", F.coalesce("error_code", unserved).alias("error_code")).where(
        "error_code is not null").dropDuplicates(["version_id"])
    good = inputs.join(over, "version_id", "left_anti").drop("error_code", "tokens", "filename")
    made_vectors = [embed(good.where(F.col("modality") == m), maker) for m, maker in sorted(embedders.items())]
    texts = reduce(DataFrame.unionByName, made_vectors)
    location = F.struct("start", "end", "page", "section", "start_seconds", "end_seconds", "kind", "type")
    fresh = cut_lineage(texts.withColumn("location", location).withColumn("error_code", vector_error(F.col("embedding"), F.size("embedding"))))
    broken = fresh.where("error_code is not null").select("version_id", "error_code").distinct()
    fresh = fresh.join(broken.select("version_id"), "version_id", "left_anti")
    shape = ["segment_id", "version_id", "profile_id", "ordinal", "modality", "location", "content", "token_count",
             "embedding"]
    ready = fresh.select(*shape).unionByName(copied.select(*shape))
    known = segments.select("segment_id")
    catalog.append("segments", ready.join(known, "segment_id", "left_anti").withColumn("workspace_id", ws))

    spent = embed_usage(fresh).select(ws.alias("workspace_id"), "kind", "quantity", "idem_key", F.current_timestamp().alias("created_at"))
    charged = catalog.read("usage_events", workspace_id).select("idem_key")
    catalog.append("usage_events", spent.join(charged, "idem_key", "left_anti"))

    refused = failed.select("version_id", "error_code").unionByName(unread).unionByName(over).unionByName(broken)
    bad = cut_lineage(refused.dropDuplicates(["version_id"]))
    published = new_versions.join(bad, "version_id", "left_anti")
    catalog.append("file_versions", published.join(versions.select("version_id"), "version_id", "left_anti"))
    born = plan.where("action = 'new_file'").join(bad, "version_id", "left_anti").dropDuplicates(["file_id"]).select(
        ws.alias("workspace_id"), "file_id", "path", F.lit(None).cast("string").alias("current_version_id"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    batch = plan.where("version_id is not null").join(bad, "version_id", "left_anti").select(
        "store_id", "file_id", "version_id")
    now = catalog.read("file_versions", workspace_id)
    new_pairs = publish_members(members, batch).join(members.select("store_id", "file_id"), ["store_id", "file_id"],
                                                     "left_anti")
    catalog.append("store_files", new_pairs.withColumn("workspace_id", ws).withColumn("added_at", F.current_timestamp()))
    touched = files.unionByName(born.join(files.select("file_id"), "file_id", "left_anti")).join(
        batch.select("file_id"), "file_id", "left_semi")
    catalog.append("files", publish(touched, now, batch).withColumn("updated_at", F.current_timestamp()))

    catalog.append("deliveries", items.join(folded.select("item_id", "modified_at"), "item_id").select(
        ws.alias("workspace_id"), "store_id", "path", "sha256", "modified_at"))
    done = plan.join(bad, "version_id", "left").select(
        "item_id", "path", "file_id", "version_id", F.coalesce("error_code", F.when(F.col("action") == "NOT_FOUND", "NOT_FOUND")).alias("error_code"))
    others = folded.where("fold <> 'publish'").select("item_id", "path", F.col("fold").alias("outcome")).unionByName(
        each.where("reason is not null").select("item_id", "path", F.col("reason").alias("error_code")), allowMissingColumns=True)
    every = cut_lineage(done.withColumn("outcome", F.coalesce("error_code", F.lit("succeeded"))).unionByName(others, allowMissingColumns=True))
    catalog.append("job_items", every.select(
        ws.alias("workspace_id"), "item_id", F.lit(job_id).alias("job_id"), "path", "file_id", "version_id",
        F.when(F.col("error_code").isNull(), "succeeded").otherwise("failed").alias("state"),
        (F.col("error_code") == "SERVICE_UNAVAILABLE").alias("retryable"), "error_code", F.current_timestamp().alias("updated_at")))
    return every.select("path", F.coalesce("outcome", "error_code").alias("outcome"))


def stream_ingest(spark: SparkSession, folder: str, catalog: Catalog, workspace_id: str, store_id: str,
                  profile: Profile, make_embedder: Callable[[], Embedder] | dict[str, Callable[[], Embedder]], checkpoint: str,
                  available_now: bool = True, decode: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
                  on_outcomes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the continuous job. Each micro-batch is one publication; ``on_outcomes`` gets (path, outcome) of each."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        outcomes = ingest_batch(catalog, batch, workspace_id, store_id, profile, make_embedder, decode)
        if on_outcomes:
            on_outcomes(outcomes, batch_id)

    writer = new_files(spark, folder).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
