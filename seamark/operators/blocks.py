"""Block documents (headings, paragraphs, table rows in order): offsets, section paths, passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.functions.running import last_before, running_sum
from seamark.operators.chunking import (PASSAGE_DDL, SECTION_CHARS, SECTION_JOIN, Unit, explode_texts, fixed_passages,
                                        pack_units, sentence_units)
from seamark.profiles import TextPreparation

TITLE_LEVEL, DEEPEST_LEVEL = 0, 9


def row_text(cells: Column) -> Column:
    """Cells of a row joined by ' | '; a merged cell, repeated by the source, is kept once."""
    trimmed = F.transform(cells, lambda c: F.trim(c))
    distinct = F.filter(trimmed, lambda c, i: (i == 0) | (c != F.get(trimmed, i - 1)))
    return F.array_join(distinct, " | ")


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks(doc_id, seq, kind, level, text, cells)`` to non-empty lines with their text."""
    text = F.when(F.col("kind") == "row", row_text(F.col("cells"))).otherwise(F.trim("text"))
    return (blocks.withColumn("text", text).drop("cells")
            .where(F.col("text").isNotNull() & (F.translate("text", " |", "") != "")))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Add start/end offsets in the extracted text: blocks are two characters apart, rows of one table one apart."""
    nxt = F.lead("kind").over(W.partitionBy("doc_id", F.floor(F.col("seq") / 65536)).orderBy("seq"))
    # the last row of an offset block asks its successor through the running helper's block edge
    edge = blocks.groupBy("doc_id", F.floor(F.col("seq") / 65536).alias("__b")).agg(
        F.min_by("kind", "seq").alias("__first"))
    follow = edge.withColumn("__next_first", F.lead("__first").over(W.partitionBy("doc_id").orderBy("__b"))
                             ).select("doc_id", "__b", "__next_first")
    marked = (blocks.withColumn("__b", F.floor(F.col("seq") / 65536)).withColumn("__next", nxt)
              .join(follow, ["doc_id", "__b"], "left")
              .withColumn("__next", F.coalesce("__next", "__next_first")).drop("__b", "__next_first"))
    inside_table = (F.col("kind") == "row") & (F.coalesce("__next", F.lit("")) == "row")
    step = F.length("text") + F.when(inside_table, 1).otherwise(2)
    placed = running_sum(marked, ["doc_id"], "seq", step, "start", inclusive=False).drop("__next")
    return (placed.withColumn("start", F.col("start").cast("int"))
            .withColumn("end", (F.col("start") + F.length("text")).cast("int")))


def section_paths(blocks: DataFrame) -> DataFrame:
    """Add ``section``: titles of the open headings joined by ' › '.

    A heading is open until one of its own or a higher level follows; so the last heading of each level counts if no
    higher level came after it.
    """
    df = blocks
    is_heading = F.col("kind") == "heading"
    for level in range(TITLE_LEVEL, DEEPEST_LEVEL + 1):
        at_level = F.when(is_heading & (F.col("level") == level), F.struct("seq", "text"))
        df = df.withColumn(f"__h{level}", at_level)
    blockwise = W.partitionBy("doc_id", F.floor(F.col("seq") / 65536)).orderBy("seq").rowsBetween(
        W.unboundedPreceding, 0)
    names = [f"__h{level}" for level in range(TITLE_LEVEL, DEEPEST_LEVEL + 1)]
    # carry of the blocks before: one row per 65536 blocks
    ends = df.groupBy("doc_id", F.floor(F.col("seq") / 65536).alias("__b")).agg(
        *[F.max(n).alias(n) for n in names])  # the struct starts with seq, so max is the latest heading
    before = W.partitionBy("doc_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("doc_id", "__b", *[F.max(n).over(before).alias(n + "c") for n in names])
    df = df.withColumn("__b", F.floor(F.col("seq") / 65536)).join(carry, ["doc_id", "__b"])
    df = df.select("*", *[F.coalesce(F.max(n).over(blockwise), F.col(n + "c")).alias(n + "o") for n in names])
    parts = []
    for level in range(TITLE_LEVEL, DEEPEST_LEVEL + 1):
        own = F.col(f"__h{level}o")
        higher = [F.col(f"__h{j}o")["seq"] for j in range(TITLE_LEVEL, level)]
        is_open = own.isNotNull()
        for seq in higher:
            is_open = is_open & (F.coalesce(seq, F.lit(-1)) < own["seq"])
        parts.append(F.when(is_open, own["text"]))
    df = df.withColumn("section", F.array_join(F.array_compact(F.array(*parts)), SECTION_JOIN))
    return df.drop("__b", *names, *[n + "c" for n in names], *[n + "o" for n in names])


def asof_section(segments: DataFrame, headings: DataFrame) -> DataFrame:
    """Add to ``segments(doc_id, segment_id, start, ...)`` the last heading ``(doc_id, off, title)`` at or before it."""
    rows = segments.withColumn("__at", F.col("start")).withColumn("__kind", F.lit(1)).withColumn(
        "__title", F.lit(None).cast("string"))
    marks = headings.select("doc_id", F.col("off").alias("__at"), F.lit(0).alias("__kind"),
                            F.col("title").alias("__title"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    found = last_before(both, ["doc_id"], "__at", "__kind", F.col("__title"), "section")
    return (found.where("__kind = 1").withColumn("section", F.substring("section", 1, SECTION_CHARS))
            .drop("__at", "__kind", "__title"))


def _units_of_blocks(lines: DataFrame) -> DataFrame:
    """Paragraphs become sentence units; headings and rows stay whole. Each table's first row is its header."""
    is_row = F.col("kind") == "row"
    group = W.partitionBy("doc_id").orderBy("seq")
    begins = is_row & (F.coalesce(F.lag("kind").over(group), F.lit("")) != "row")
    header = F.last(F.when(begins, F.col("text")), ignorenulls=True).over(group)
    lines = lines.withColumn("header", F.when(is_row, header)).withColumn("heading", F.col("kind") == "heading")
    whole = lines.where("kind <> 'paragraph'").select(
        "doc_id", "seq", "start", "end", "text", "section", "header", "heading")
    prose = explode_texts(
        lines.where("kind = 'paragraph'").select("doc_id", "seq", F.col("start").alias("base"), "section", "text"),
        "text", lambda v: [(u.start, u.end, u.text) for u in sentence_units(v)],
        [("s", "int32"), ("e", "int32"), ("body", "string")], "s int, e int, body string")
    sentences = prose.select("doc_id", "seq", (F.col("base") + F.col("s")).alias("start"),
                             (F.col("base") + F.col("e")).alias("end"), F.col("body").alias("text"), "section",
                             F.lit(None).cast("string").alias("header"), F.lit(False).alias("heading"))
    return whole.unionByName(sentences)


def prepare_blocks(blocks: DataFrame, cfg: TextPreparation) -> DataFrame:
    """Passages of block documents: doc_id, start, end, section, content.

    Packing never crosses a section, so a run of blocks in one section is the unit of parallel work.
    """
    placed = block_offsets(flatten_blocks(blocks))
    if cfg.strategy != "structure":
        return _fixed_blocks(placed, cfg)
    units = _units_of_blocks(section_paths(placed))
    changed = F.when(F.col("section") != F.lag("section").over(W.partitionBy("doc_id").orderBy("start", "end")), 1)
    runs = units.withColumn("run", F.count(changed).over(W.partitionBy("doc_id").orderBy("start", "end")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"])
        rows = [Unit(*r) for r in zip(pdf["start"].tolist(), pdf["end"].tolist(), pdf["text"], pdf["section"],
                                      (h if isinstance(h, str) else None for h in pdf["header"]),
                                      pdf["heading"].tolist())]
        out = pd.DataFrame(pack_units(rows, cfg), columns=["start", "end", "section", "content"])
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out

    doc_type = blocks.schema["doc_id"].dataType.simpleString()
    return runs.groupBy("doc_id", "run").applyInPandas(pack, f"doc_id {doc_type}, {PASSAGE_DDL}")


def _fixed_blocks(placed: DataFrame, cfg: TextPreparation) -> DataFrame:
    gap = F.when(F.lead("kind").over(W.partitionBy("doc_id").orderBy("seq")).eqNullSafe("row")
                 & (F.col("kind") == "row"), "\n").otherwise("\n\n")
    glued = placed.withColumn("__glued", F.concat("text", gap))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "__glued")))
    text = F.array_join(F.transform(ordered, lambda s: s["__glued"]), "")
    full = glued.groupBy("doc_id").agg(F.regexp_replace(text, "\n\n$", "").alias("text"))
    passages = explode_texts(full, "text", lambda v: [(p.start, p.end, p.content) for p in fixed_passages(v, cfg)],
                             [("start", "int32"), ("end", "int32"), ("content", "string")],
                             "`start` int, `end` int, content string")
    headings = placed.where("kind = 'heading'").select("doc_id", F.col("start").alias("off"),
                                                       F.col("text").alias("title"))
    return asof_section(passages, headings).select("doc_id", "start", "end", "section", "content")
