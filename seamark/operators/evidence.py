"""From hits to source-linked evidence and to the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.session import cut_lineage

MAX_HITS = 100_000  # hits, without their text, that may be broadcast


def evidence(hits: DataFrame, segments: DataFrame, members: DataFrame, files: DataFrame,
             versions: DataFrame) -> DataFrame:
    """Rows for ``hits(query_id, segment_id, distance, rank)``: score, content or media reference, source.

    ``members`` are those of one store. Files are checked to be live once more after the ranking: a deletion can only
    shrink a result. Every join keeps at most one row per hit, so with few hits (counted) each big table is scanned in
    place and the hits are broadcast; with many, joins shuffle.
    """
    asked = cut_lineage(hits)
    few = asked.count() <= MAX_HITS
    side = F.broadcast if few else (lambda rows: rows)
    alive = files.where(F.col("deleted_at").isNull()).select("file_id", "path", "metadata")
    found = segments.select("segment_id", "version_id", "modality", "location").join(side(asked), "segment_id")
    owned = members.select("file_id", "version_id").join(side(found), "version_id")
    lived = alive.join(side(owned), "file_id")
    named = versions.select("version_id", "version_no", "filename", "media_type").join(side(lived), "version_id")
    # the text comes last and in its own row, so no broadcast carries it
    rows = segments.select("segment_id", "content").join(side(named), "segment_id")
    is_text = F.col("modality") == "text"
    media_url = F.concat(F.lit("/files/"), F.col("file_id"), F.lit("/content?version_id="), F.col("version_id"))
    source = F.struct("file_id", "version_id", "version_no", "filename", "path", "media_type", "location", "metadata")
    extra = [c for c in ("modality_rank", "keyword_rank", "vector_rank") if c in hits.columns]
    return rows.select("query_id", "rank", "segment_id", F.round(1 - F.col("distance"), 6).alias("score"), "modality",
                       F.when(is_text, F.col("content")).alias("content"), F.when(~is_text, media_url).alias("media_url"),
                       source.alias("source"), *extra)


def place_label(location: Column) -> Column:
    """Readable place of a segment: seconds, page, or section and characters."""
    at = lambda name: location[name]
    section = F.when(F.length(at("section")) > 0, F.concat(F.lit("section '"), at("section"), F.lit("', "))).otherwise("")
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    return (F.when(at("start_seconds").isNotNull(), F.concat(whole(at("start_seconds")), F.lit("-"),
                                                             whole(at("end_seconds")), F.lit("s")))
            .when(at("page").isNotNull(), F.concat(F.lit("page "), at("page").cast("string")))
            .when(at("start").isNotNull(), F.concat(section, F.lit("chars "), at("start").cast("string"), F.lit("-"),
                                                    at("end").cast("string")))
            .otherwise("whole image"))


def build_context(found: DataFrame, max_images: int = 2) -> DataFrame:
    """(query_id, context, images): numbered, cited passages of the evidence rows, and the first images attached.

    A query has at most k evidence rows, so a group is small by construction.
    """
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source.path"), F.lit(" ("),
                     place_label(F.col("source.location")), F.lit(")\n"))
    rows = found.select("query_id", F.struct("rank", label.alias("label"), "modality", "content",
                                             F.col("source.version_id").alias("version_id")).alias("r"))
    grouped = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    images = F.filter(F.col("rs"), lambda r: r["modality"] == "image")

    def line(r):
        number = F.array_position("attached", r["rank"])
        shown = F.when(number > 0, F.concat(F.lit(" (attached as image "), number.cast("string"), F.lit(")"))).otherwise("")
        media = F.concat(F.lit("<"), r["modality"], F.lit(" segment from this file>"), shown)
        return F.concat(r["label"], F.when(r["modality"] == "text", F.coalesce(r["content"], F.lit(""))).otherwise(media))

    first = F.slice(images, 1, max_images)
    with_images = grouped.withColumn("attached", F.transform(first, lambda r: r["rank"]))
    return with_images.select("query_id", F.array_join(F.transform("rs", line), "\n\n").alias("context"),
                              F.transform(first, lambda r: r["version_id"]).alias("images"))
