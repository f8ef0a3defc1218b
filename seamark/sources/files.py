"""Folder scan, format and path gate, byte verification, content-addressed copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamark.functions.text import nfc

MAX_FILE_BYTES = 512 * 1024 * 1024  # fixed value: larger sources are refused
MAX_PATH_CHARS = 1024  # fixed value

# Accepted extensions with media type and modality.
FORMATS = [
    (".txt", "text/plain", "text"),
    (".md", "text/markdown", "text"),
    (".markdown", "text/markdown", "text"),
    (".pdf", "application/pdf", "text|image"),
    (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text"),
    (".jpg", "image/jpeg", "image"),
    (".jpeg", "image/jpeg", "image"),
    (".png", "image/png", "image"),
    (".wav", "audio/wav", "audio"),
    (".mp3", "audio/mpeg", "audio"),
    (".mp4", "video/mp4", "video"),
]


def scan_corpus(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file below ``root``: path relative to it, size, bytes. The bytes are read only if a later step uses them.

    Spark's file index already leaves out empty files and names starting with '.' or '_'; the gate reports those when the
    listing comes from a manifest.
    """
    base = root.rstrip("/") + "/"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(root))
    relative = F.element_at(F.split(F.col("path"), F.lit(r"\Q" + base + r"\E"), 2), -1)
    return raw.select(relative.alias("path"), F.col("length").alias("size"), "content",
                      F.col("modificationTime").alias("modified_at"))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.[^./]+$", 0)


def media_type(path: Column) -> Column:
    """Media type by extension, null if the format is not accepted."""
    ext = extension(path)
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, kind, _ in FORMATS:
        found = found.when(ext == suffix, kind)
    return found


def modality(path: Column) -> Column:
    ext = extension(path)
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, _, kind in FORMATS:
        found = found.when(ext == suffix, kind)
    return found


def is_safe_path(path: Column) -> Column:
    """Relative path inside the folder: no absolute or drive path, no '.', '..' or empty part, no control character."""
    parts = F.split(path, "/")
    return ((F.length(path) >= 1) & (F.length(path) <= MAX_PATH_CHARS) & ~path.contains("\\")
            & ~path.rlike(r"[\x00-\x1f\x7f]") & ~path.rlike("^[A-Za-z]:")
            & F.forall(parts, lambda p: ~p.isin("", ".", "..")))


def rejection(path: Column, size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why a file is not taken, or null."""
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith("."))
    return (F.when(~is_safe_path(path), "unsafe path")
            .when(hidden, "hidden")
            .when(media_type(path).isNull(), "unsupported format")
            .when(size == 0, "empty file")
            .when(size > max_bytes, "too large"))


def gated(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``files(path, size, ...)`` with the NFC path, media type, modality and reject reason (null: accepted)."""
    path = F.col("path")
    return (files.withColumn("path", nfc(path)).withColumn("media_type", media_type(path))
            .withColumn("modality", modality(path)).withColumn("reason", rejection(path, F.col("size"), max_bytes)))


def gate_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rejected rows keep their reason."""
    checked = gated(files, max_bytes)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def verify_checksums(received: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare received bytes ``(file_id, content)`` with ``manifest(file_id, size, sha256)``.

    Hash and length are taken before the join, so the bytes themselves are never shuffled.
    """
    digests = received.select("file_id", F.sha2("content", 256).alias("__sha"),
                              F.octet_length("content").cast("long").alias("__size"))
    joined = manifest.join(digests, "file_id", "left")
    same = (F.col("__sha") == F.col("sha256")) & (F.col("__size") == F.col("size"))
    return joined.withColumn("outcome", F.when(F.col("__sha").isNull(), "UPLOAD_MISSING")
                             .when(same, "VERIFIED").otherwise("CHECKSUM_MISMATCH")).drop("__sha", "__size")


def dedup_blobs(versions: DataFrame) -> DataFrame:
    """One stored copy per (workspace, sha256), with how many references it serves and the bytes saved."""
    return versions.groupBy("workspace_id", "sha256").agg(
        F.min("size").alias("size"), F.min("version_id").alias("first_version_id"),
        F.count(F.lit(1)).alias("refs"), F.min("created_at").alias("created_at")
    ).withColumn("saved_bytes", (F.col("refs") - 1) * F.col("size"))
