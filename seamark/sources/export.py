"""Export of a store's indexed segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def export_segments(members: DataFrame, segments: DataFrame, files: DataFrame, versions: DataFrame,
                    include: Sequence[str] = ("content", "embedding")) -> DataFrame:
    """One row per segment of the members, with its source. Columns not asked for are pruned from the scan."""
    unknown = set(include) - {"content", "embedding"}
    if unknown:
        raise ValueError(f"include accepts content, embedding; not {sorted(unknown)}")
    named = (members.select("store_id", "file_id", "version_id").join(files.select("file_id", "path", "metadata"), "file_id")
             .join(versions.select("version_id", "version_no", "filename", "media_type", "sha256"), "version_id"))
    # text and vectors come last: they are shuffled once, before they are repeated for every store that shows them
    rows = named.join(segments.select("version_id", "segment_id", "profile_id", "ordinal", "modality", "token_count",
                                      "location", *include), "version_id")
    source = F.struct("file_id", "version_id", "version_no", "path", "filename", "media_type", "sha256", "metadata",
                      "location")
    return rows.select("segment_id", "store_id", "profile_id", "modality", "ordinal", "token_count",
                       source.alias("source"), *include)


def write_export(export: DataFrame, path: str) -> None:
    """JSON lines, one file per task: nothing is gathered into one writer."""
    export.write.mode("errorifexists").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a written export with their vectors: (segment_id, store_id, modality, embedding)."""
    return spark.read.schema("segment_id string, store_id string, modality string, embedding array<float>").json(path)
