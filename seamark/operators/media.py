"""Audio and video: time windows, soundtrack windows, transcript passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seamark.functions.running import running_number
from seamark.profiles import MediaPreparation

END_TOLERANCE = 0.05  # fixed value: a window does not start in the last 0.05 s
SHORT_TAIL, STRETCH = 0.3, 1.3  # fixed values: tails below 30 % of a window join it, up to 130 %
NO_SPEECH = 0.6  # fixed value: lines at or above this no-speech probability are noise
SOUNDTRACK_SECONDS = 1.0  # fixed value: shorter sound gives no soundtrack windows


def _windows(duration: Column, seconds: float, overlap: float) -> Column:
    stride = seconds - overlap if 0 < overlap < seconds else seconds
    last = F.greatest(F.ceil((duration - seconds) / stride), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * F.lit(stride)).cast("double").alias("s"),
        F.least(duration, i * F.lit(stride) + F.lit(seconds)).cast("double").alias("e")))
    spans = F.filter(spans, lambda w: w["s"] < duration - END_TOLERANCE)
    if overlap:
        tail, before = F.get(spans, F.size(spans) - 1), F.get(spans, F.size(spans) - 2)
        joins = ((F.size(spans) > 1) & (tail["e"] - tail["s"] < SHORT_TAIL * seconds)
                 & (tail["e"] - before["s"] <= STRETCH * seconds))
        merged = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 2, F.lit(0))),
                          F.array(F.struct(before["s"].alias("s"), tail["e"].alias("e"))))
        spans = F.when(joins, merged).otherwise(spans)
    return F.transform(spans, lambda w: F.struct(F.round(w["s"], 3).alias("start_seconds"),
                                                 F.round(w["e"], 3).alias("end_seconds")))


def time_windows(media: DataFrame, seconds: float, overlap: float = 0.0) -> DataFrame:
    """Windows of ``media(..., duration)``: one row per window with start_seconds, end_seconds."""
    spans = F.when(F.col("duration") > END_TOLERANCE, _windows(F.col("duration"), seconds, overlap))
    return media.select("*", F.posexplode(spans).alias("window_no", "w")).select(
        *media.columns, "window_no", "w.start_seconds", "w.end_seconds")


def soundtrack_windows(media: DataFrame, cfg: MediaPreparation) -> DataFrame:
    """Windows over the sound of ``media(..., duration, audio_seconds)``, tagged kind=soundtrack."""
    heard = media.where(F.col("audio_seconds") >= SOUNDTRACK_SECONDS)
    return (time_windows(heard, cfg.segment_seconds, cfg.overlap_seconds)
            .withColumn("modality", F.lit("audio")).withColumn("kind", F.lit("soundtrack")))


def _starts(chars: np.ndarray, max_chars: int) -> np.ndarray:
    """next[i]: first line that no longer fits a passage starting at line i."""
    total = np.concatenate([[0], np.cumsum(chars)])
    return np.maximum(np.searchsorted(total, total[:-1] + max_chars, side="right") - 1, np.arange(len(chars)) + 1)


def spoken_lines(lines: DataFrame) -> DataFrame:
    """Lines that carry speech."""
    return lines.where((F.col("no_speech_prob") < NO_SPEECH) & (F.trim("text") != ""))


def group_transcript(lines: DataFrame, max_chars: int = 600, piece_lines: int = 262144) -> DataFrame:
    """Passages of consecutive lines of ``lines(media_id, line_no, start, end, text, no_speech_prob)``.

    Greedy grouping: a line opens a new passage if it would take the current one over ``max_chars``. Where the passages
    of a medium begin depends on all lines before, yet one medium may hold any number of lines. So the lines are cut
    into pieces. A medium of one piece is walked at once. For a longer one, each piece is walked from every line a
    passage could open at (at most ``max_chars`` of them), which gives a small map from entry line to exit line; chaining
    the maps tells every piece where its first passage opens. No task sees more than a piece and the lines that reach
    into it. Python gets the line lengths of many pieces per Arrow batch.
    """
    piece_lines = max(piece_lines, 2 * max_chars)  # a passage reaches into the next piece at most
    spoken = spoken_lines(lines).select("media_id", "line_no", "start", "end", "text", F.length("text").alias("chars"))
    numbered = running_number(spoken, ["media_id"], ["line_no"], "line_no", "n", piece_lines)
    pieces = numbered.withColumn("piece", F.floor(F.col("n") / piece_lines).cast("int"))
    listed = pieces.groupBy("media_id", "piece").agg(F.sort_array(F.collect_list(
        F.struct("n", "chars", "start", "end", "text"))).alias("lines")).withColumn("chars", F.col("lines.chars"))
    placed = listed.join(_entries(pieces, max_chars, piece_lines), ["media_id", "piece"], "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for piece, chars, entry, carry in zip(*(batch.column(c).to_pylist() for c in ("piece", "chars", "entry", "carry"))):
                first = piece * piece_lines
                following = _starts(np.asarray(chars), max_chars)
                passage = np.full(len(chars), -1 if carry is None else carry)
                at = (first if entry is None else entry) - first
                while at < len(chars):
                    passage[at:following[at]] = first + at
                    at = int(following[at])
                ids.append(passage)
            passages = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("lines"), passages],
                                             names=["media_id", "lines", "passages"])

    media_type = lines.schema["media_id"].dataType.simpleString()
    walked = placed.mapInArrow(walk, f"media_id {media_type}, lines {listed.schema['lines'].dataType.simpleString()}, "
                                     "passages array<bigint>")
    each = walked.select("media_id", F.explode(F.arrays_zip("lines", "passages")).alias("z")).select(
        "media_id", F.col("z.passages").alias("passage"), "z.lines.*")
    ordered = F.sort_array(F.collect_list(F.struct("n", F.trim("text").alias("t"))))
    return each.groupBy("media_id", "passage").agg(
        F.round(F.min_by("start", "n"), 2).alias("start_seconds"), F.round(F.max_by("end", "n"), 2).alias("end_seconds"),
        F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("content"), F.count(F.lit(1)).alias("lines")
    ).withColumn("kind", F.lit("transcript"))


def _entries(pieces: DataFrame, max_chars: int, piece_lines: int) -> DataFrame:
    """(media_id, piece, entry, carry) for media of several pieces: the first line of the piece that opens a passage, and
    the passage that the lines before it belong to."""
    long_media = pieces.where(F.col("piece") > 0).select("media_id").distinct()
    own = pieces.join(long_media, "media_id", "left_semi").select("media_id", "piece", "n", "chars")
    # lines at the head of a piece are also seen by the piece before: a passage may reach over the edge
    reach = own.where((F.col("piece") > 0) & (F.col("n") % piece_lines <= max_chars)).withColumn("piece", F.col("piece") - 1)
    sized = own.unionByName(reach).groupBy("media_id", "piece").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "chars"))), lambda s: s["chars"]).alias("chars"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, entry, leave, last = [], [], [], []
            for row, (piece, chars) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("chars").to_pylist())):
                first, count = piece * piece_lines, min(len(chars), piece_lines)
                following = _starts(np.asarray(chars), max_chars)
                out, opened = np.arange(len(chars) + 1), np.full(len(chars) + 1, -1)
                for i in range(count - 1, -1, -1):
                    out[i] = out[following[i]]
                    opened[i] = i if following[i] >= count else opened[following[i]]
                heads = min(count, max_chars + 1)
                source += [row] * heads
                entry += range(first, first + heads)
                leave += (first + out[:heads]).tolist()
                last += (first + opened[:heads]).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("media_id").take(pa.array(source, pa.int64())), *(pa.array(v, pa.int64()) for v in (entry, leave, last))],
                names=["media_id", "entry", "leave", "last"])

    media_type = pieces.schema["media_id"].dataType.simpleString()
    hops = sized.mapInArrow(exits, f"media_id {media_type}, entry bigint, leave bigint, last bigint")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        step = {e: (leave, last) for e, leave, last in zip(pdf["entry"].tolist(), pdf["leave"].tolist(), pdf["last"].tolist())}
        rows, at, carry = [], 0, None
        while True:
            rows.append((pdf["media_id"].iloc[0], at // piece_lines, at, carry))
            if at not in step:
                return pd.DataFrame(rows, columns=["media_id", "piece", "entry", "carry"]).astype({"carry": "Int64"})
            at, carry = step[at]

    return hops.groupBy("media_id").applyInPandas(chain, f"media_id {media_type}, piece int, entry bigint, carry bigint")
