"""Upload manifests: validation of a session and completeness of its parts."""

from pyspark.sql import DataFrame, functions as F

from seamark.sources.files import MAX_FILE_BYTES, media_type

MAX_SESSION_FILES = 1000  # fixed value


def validate_manifest(manifest: DataFrame, quotas: DataFrame, max_files: int = MAX_SESSION_FILES,
                      max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One verdict per session of ``manifest(workspace_id, session_id, path, size)``.

    ``quotas(workspace_id, remaining_bytes)``; a null remaining means no cap. Paths are counted first, so a session
    with very many entries is reduced map-side and never becomes one task.
    """
    per_path = manifest.groupBy("workspace_id", "session_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        F.count_if(F.col("size") > max_bytes).alias("oversize"))
    sessions = per_path.groupBy("workspace_id", "session_id").agg(
        F.sum("n").alias("files"), F.count_if(F.col("n") > 1).alias("duplicate_paths"),
        F.sum("oversize").alias("oversize_files"),
        F.count_if(media_type(F.col("path")).isNull()).alias("unsupported_files"),
        F.sum("bytes").alias("total_bytes"))
    over_quota = F.col("remaining_bytes").isNotNull() & (F.col("total_bytes") > F.col("remaining_bytes"))
    return sessions.join(quotas, "workspace_id", "left").withColumn(
        "verdict", F.when(F.col("files") > max_files, "INPUT_TOO_LARGE")
        .when(F.col("duplicate_paths") > 0, "INVALID_REQUEST")
        .when(F.col("oversize_files") > 0, "INPUT_TOO_LARGE")
        .when(F.col("unsupported_files") > 0, "FORMAT_UNSUPPORTED")
        .when(over_quota, "QUOTA_EXCEEDED").otherwise("ACCEPTED"))


def expected_parts(files: DataFrame) -> DataFrame:
    """One row per part a file should have, with its exact size; the last part holds the rest."""
    n = F.greatest(F.ceil(F.col("size") / F.col("part_size")), F.lit(1)).cast("int")
    parts = files.withColumn("parts", n).withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    rest = F.col("size") - (F.col("parts") - 1) * F.col("part_size")
    return parts.withColumn("expected_size", F.when(F.col("part_no") < F.col("parts"), F.col("part_size"))
                            .otherwise(rest).cast("long"))


def missing_parts(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts that are absent or of the wrong size: one row per (file, part)."""
    received = parts.groupBy("file_id", "part_no").agg(F.max("size").alias("received_size"))
    joined = expected_parts(files).join(received, ["file_id", "part_no"], "left")
    return joined.withColumn("problem", F.when(F.col("received_size").isNull(), "missing")
                             .when(F.col("received_size") != F.col("expected_size"), "wrong size")
                             ).where(F.col("problem").isNotNull())


def completeness(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Per file: parts expected, parts received, complete or not."""
    received = parts.groupBy("file_id", "part_no").agg(F.lit(1).alias("one")).groupBy("file_id").agg(
        F.sum("one").alias("received"))
    expected = F.greatest(F.ceil(F.col("size") / F.col("part_size")), F.lit(1)).cast("long")
    return (files.withColumn("expected", expected).join(received, "file_id", "left")
            .withColumn("received", F.coalesce("received", F.lit(0)))
            .withColumn("complete", F.col("expected") == F.col("received")))
