"""Page-routed preparation: pages with text become passages, other pages become images plus their recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.operators.chunking import chunk_with, structure_passages, text_passages
from seamark.profiles import PagePreparation, TextPreparation


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _chars(text: Column) -> Column:
    """Length without surrounding white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def route_pages(pages: DataFrame, cfg: PagePreparation) -> DataFrame:
    """Add ``route``: text, image, or image+ocr."""
    has_text = _chars(F.col("text")) >= cfg.text_min_chars
    has_words = F.lit(cfg.ocr) & (_chars(F.col("ocr_text")) >= cfg.text_min_chars)
    return pages.withColumn("route", F.when(has_text, "text").when(has_words, "image+ocr").otherwise("image"))


def prepare_pages(pages: DataFrame, cfg: PagePreparation, text_cfg: TextPreparation) -> DataFrame:
    """Segments of ``pages(doc_id, page, text, ocr_text)``: doc_id, modality, page, kind, start, end, section, content."""
    routed = route_pages(pages.withColumn("text", unix_lines(F.col("text"))), cfg)
    none = F.lit(None)
    shape = ["doc_id", "modality", "page", "kind", "start", "end", "section", "content"]
    body = routed.where("route = 'text'").select("doc_id", "page", "text")
    passages = (chunk_with(body, "text", lambda v: text_passages(v, text_cfg, markdown=False))
                .withColumn("modality", F.lit("text")).withColumn("kind", none.cast("string")))
    images = routed.where("route <> 'text'").select(
        "doc_id", "page", F.lit("image").alias("modality"), none.cast("string").alias("kind"),
        none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("string").alias("section"),
        none.cast("string").alias("content"))
    segments = passages.select(*shape).unionByName(images.select(*shape))
    if not cfg.ocr:
        return segments
    words = routed.where("route = 'image+ocr'").select("doc_id", "page", "ocr_text")
    # recognised words always use structure packing, whatever the strategy for page text
    found = (chunk_with(words, "ocr_text", lambda v: structure_passages(v, text_cfg, markdown=False))
             .withColumn("modality", F.lit("text")).withColumn("kind", F.lit("ocr")))
    return segments.unionByName(found.select(*shape))


def assemble_ocr(lines: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Text of each page from ``lines(page_id, x, y, text, confidence)``: reading order, sure lines only."""
    kept = lines.where(F.col("confidence") >= min_confidence)
    placed = F.struct(F.bround(F.col("y") / 12).alias("row"), F.col("x").alias("x"), F.col("text").alias("text"))
    ordered = F.sort_array(F.collect_list(placed))
    return kept.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"),
                                       F.count(F.lit(1)).alias("n_lines"))
