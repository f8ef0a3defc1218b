"""Preparation of source files: decode, route by media type, cut, number. Failures are outcome rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.functions.ids import segment_id
from seamark.functions.running import running_number
from seamark.functions.text import contextual_title, document_input
from seamark.operators.blocks import prepare_blocks
from seamark.operators.chunking import chunk_with, text_passages
from seamark.operators.media import group_transcript, soundtrack_windows, time_windows
from seamark.operators.pages import prepare_pages
from seamark.profiles import Profile

# Media types by preparation path.
TEXT_TYPES = ["text/plain", "text/markdown"]
BLOCK_TYPES = ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
PAGE_TYPES = ["application/pdf"]
IMAGE_TYPES = ["image/jpeg", "image/png"]
AUDIO_TYPES = ["audio/wav", "audio/mpeg"]
VIDEO_TYPES = ["video/mp4"]
KNOWN_TYPES = TEXT_TYPES + BLOCK_TYPES + PAGE_TYPES + IMAGE_TYPES + AUDIO_TYPES + VIDEO_TYPES

SEGMENT_COLUMNS = ["version_id", "modality", "start", "end", "page", "section", "start_seconds", "end_seconds", "kind",
                   "type", "content"]
_TYPES = dict(start="int", end="int", page="int", section="string", start_seconds="double", end_seconds="double",
              kind="string", type="string", content="string")


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` and ``error_code`` to rows with UTF-8 bytes: a byte-order mark is cut, bad bytes or NUL are
    UNREADABLE, blank text is EMPTY_CONTENT."""
    raw = F.col(content)
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.regexp_replace(F.try_validate_utf8(raw.cast("string")), r"^\x{FEFF}", "")
    error = (F.when(~valid, "UNREADABLE").when(F.instr(text, "\x00") > 0, "UNREADABLE")
             .when(F.regexp_replace(text, r"(?U)\s+", "") == "", "EMPTY_CONTENT"))
    return files.withColumn("error_code", error).withColumn("text", F.when(F.col("error_code").isNull(), text))


def _shaped(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).cast(_TYPES[c]).alias(c) for c in SEGMENT_COLUMNS])


def _named(df: DataFrame, key: str) -> DataFrame:
    return df.withColumnRenamed(key, "version_id")


def prepare(files: DataFrame, profile: Profile, pages: DataFrame | None = None, blocks: DataFrame | None = None,
            media: DataFrame | None = None, transcript: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, outcomes) of ``files(version_id, media_type, content)``; outcomes (version_id, media_type, error_code,
    retryable) are the files without a segment.

    Decoded parts come as tables keyed by version_id: ``pages(doc_id, page, text, ocr_text)``, ``blocks(doc_id, seq,
    kind, level, text, cells)``, ``media(media_id, duration, audio_seconds)``, ``transcript(media_id, line_no, start,
    end, text, no_speech_prob)``. Every path is one branch of a union; a bad file costs its own row only.
    """
    head = files.select("version_id", "media_type")
    decoded = decode_text(files.where(F.col("media_type").isin(TEXT_TYPES)))
    texts = decoded.where("error_code is null").select("version_id", "text")
    parts = [chunk_with(texts, "text", lambda v: text_passages(v, profile.text)).withColumn("modality", F.lit("text"))]
    images = head.where(F.col("media_type").isin(IMAGE_TYPES)).select(
        "version_id", F.lit("image").alias("modality"), F.lit("whole_image").alias("type"))
    parts.append(images)

    def of_type(df: DataFrame, key: str, kinds: list[str]) -> DataFrame:
        return df.join(head.where(F.col("media_type").isin(kinds)).select(F.col("version_id").alias(key)), key,
                       "left_semi")

    if pages is not None:
        parts.append(_named(prepare_pages(of_type(pages, "doc_id", PAGE_TYPES), profile.pages, profile.text), "doc_id"))
    if blocks is not None:
        parts.append(_named(prepare_blocks(of_type(blocks, "doc_id", BLOCK_TYPES), profile.text), "doc_id")
                     .withColumn("modality", F.lit("text")))
    if media is not None:
        sound = time_windows(of_type(media, "media_id", AUDIO_TYPES), profile.audio.segment_seconds,
                             profile.audio.overlap_seconds).withColumn("modality", F.lit("audio"))
        moving = time_windows(of_type(media, "media_id", VIDEO_TYPES), profile.video.segment_seconds,
                              profile.video.overlap_seconds).withColumn("modality", F.lit("video"))
        parts += [_named(sound, "media_id"), _named(moving, "media_id")]
        if profile.soundtrack:
            parts.append(_named(soundtrack_windows(of_type(media, "media_id", VIDEO_TYPES), profile.soundtrack),
                                "media_id"))
    for kinds, cfg in ((AUDIO_TYPES, profile.audio), (VIDEO_TYPES, profile.video)):
        if transcript is not None and cfg.transcript_chars:
            spoken = group_transcript(of_type(transcript, "media_id", kinds), cfg.transcript_chars)
            parts.append(_named(spoken, "media_id").withColumn("modality", F.lit("text")))
    segments = _shaped(parts[0])
    for part in parts[1:]:
        segments = segments.unionByName(_shaped(part))

    failed_text = decoded.where("error_code is not null").select("version_id", "media_type", "error_code")
    unknown = head.where(~F.col("media_type").isin(KNOWN_TYPES) | F.col("media_type").isNull()).select(
        "version_id", "media_type", F.lit("FORMAT_UNSUPPORTED").alias("error_code"))
    silent = (head.where(F.col("media_type").isin(TEXT_TYPES + PAGE_TYPES + BLOCK_TYPES + AUDIO_TYPES + VIDEO_TYPES))
              .join(segments.select("version_id"), "version_id", "left_anti")
              .join(failed_text.select("version_id"), "version_id", "left_anti")
              .select("version_id", "media_type", F.lit("EMPTY_CONTENT").alias("error_code")))
    outcomes = failed_text.unionByName(unknown).unionByName(silent).withColumn("retryable", F.lit(False))
    return segments, outcomes


def with_ordinals(segments: DataFrame, profile_id: str) -> DataFrame:
    """Number segments in document order and give them their deterministic ids.

    Order: page, then the page's own segment before its recognised words; media windows, then soundtrack, then
    transcript; inside each by place. A long document is numbered in blocks of its place column.
    """
    stage = (F.when(F.col("kind").isin("ocr", "soundtrack"), 1).when(F.col("kind") == "transcript", 2).otherwise(0))
    moment = (F.col("__stage") * F.lit(1 << 40) + F.floor("start_seconds")).cast("long")
    place = F.coalesce(F.col("page").cast("long"), moment, F.floor(F.col("start") / F.lit(1 << 12)).cast("long"),
                       F.lit(0).cast("long"))
    ranked = running_number(
        segments.withColumn("__stage", stage).withColumn("__place", place), ["version_id"],
        ["__place", "__stage", "start_seconds", "start", "end_seconds", "end"], "__place", "ordinal", width=256)
    return (ranked.drop("__place", "__stage").withColumn("profile_id", F.lit(profile_id))
            .withColumn("segment_id", segment_id(F.col("version_id"), F.col("profile_id"), F.col("ordinal"))))


def model_inputs(segments: DataFrame, versions: DataFrame, profile: Profile) -> DataFrame:
    """Add ``input``: the text given to the model, with the passage's title in the profile's template."""
    named = segments.join(versions.select("version_id", "filename"), "version_id")
    title = (contextual_title(F.col("filename"), F.col("section"), F.col("page")) if profile.text.contextual_title
             else F.col("filename"))
    return named.withColumn("input", F.when(F.col("content").isNotNull(), document_input(
        profile.document_template, title, F.col("content"))))


def token_count(text: Column) -> Column:
    """Default tokenizer: words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def check_budget(inputs: DataFrame, text: str = "input", limit: int = 8192, tokenizer=token_count) -> DataFrame:
    """Add ``tokens`` and ``error_code``: too long an input fails, it is never shortened."""
    counted = inputs.withColumn("tokens", F.coalesce(tokenizer(F.col(text)), F.lit(0)).cast("int"))
    return counted.withColumn("error_code", F.when(F.col("tokens") > limit, "INPUT_TOO_LARGE"))


def assemble_parts(parts: DataFrame) -> DataFrame:
    """One model input per ``parts(input_id, pos, type, text)``: texts and media placeholders in their order."""
    piece = F.when(F.col("type") == "text", F.col("text")).otherwise(F.concat(F.lit("<|"), F.col("type"), F.lit("|>")))
    ordered = F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"))))
    wrong = F.count_if((F.col("type") == "text") & F.col("text").isNull())
    return parts.groupBy("input_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["piece"]), " ").alias("text"),
        F.count_if(F.col("type") != "text").alias("media_parts"),
        F.when(wrong > 0, "INVALID_REQUEST").alias("error_code"))

