"""Cutting text into located passages: fixed windows, sentence units, Markdown structure, greedy packing.

Cutting is sequential inside one text, so it runs as an Arrow-batched kernel per text row; texts spread over all tasks
and nothing is shuffled. The kernels work on offsets and prefix sums, and always on the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from seamark.functions.text import pieces
from seamark.profiles import TextPreparation
from seamark.session import dealt

# Cut points in order of preference, and the patterns of sentences, headings and table rules.
CUT_POINTS = ("\n\n", "\n", ". ", " ")
SENTENCE_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
PARAGRAPH_BREAK = re.compile(r"\n\s*\n")
HEADING_LINE = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
TABLE_RULE = re.compile(r"\|[\s:\-|]+\|?")
SECTION_JOIN = " › "
SECTION_CHARS = 200
TAIL_STRETCH = 1.25


class Unit(NamedTuple):
    """Smallest piece that packing keeps whole."""

    start: int
    end: int
    text: str
    section: str = ""
    header: str | None = None
    heading: bool = False


class Passage(NamedTuple):
    start: int
    end: int
    section: str | None
    content: str


def window_spans(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``limit`` characters that together cover every non-blank character."""
    position, total = 0, len(text)
    while position < total:
        stop = position + limit
        if stop >= total:
            if not text[position:].isspace():
                yield position, total
            return
        cuts = ((text.rfind(mark, position, stop), len(mark)) for mark in CUT_POINTS)
        stop = next((at + width for at, width in cuts if at - position > limit // 2), stop)
        if not text[position:stop].isspace():
            yield position, stop
        resume = max(stop - overlap, position + 1)
        position = text.find(" ", resume, stop) + 1 or resume


def sentence_units(text: str, base: int = 0, section: str = "") -> Iterator[Unit]:
    """Sentences with their offsets; a unit never reaches over a blank line."""
    edges = [0, *(e for m in PARAGRAPH_BREAK.finditer(text) for e in m.span()), len(text)]
    for left, right in zip(edges[::2], edges[1::2]):
        paragraph = text[left:right]
        body = paragraph.strip()
        if not body:
            continue
        left += paragraph.index(body)
        bounds = [0, *(e for m in SENTENCE_BREAK.finditer(body) for e in m.span()), len(body)]
        for begin, end in zip(bounds[::2], bounds[1::2]):
            yield Unit(base + left + begin, base + left + end, body[begin:end], section)


def markdown_units(text: str) -> Iterator[Unit]:
    """Headings, table rows and sentences in order, each with the section path it stands in."""
    lines = text.splitlines(keepends=True)
    offsets = [0, *accumulate(map(len, lines))]
    path: dict[int, str] = {}
    header: str | None = None
    prose_from: int | None = None

    def section() -> str:
        return SECTION_JOIN.join(path[level] for level in sorted(path))

    def prose(upto: int) -> Iterator[Unit]:
        if prose_from is not None:
            yield from sentence_units(text[prose_from:upto], prose_from, section())

    for line, offset in zip(lines, offsets):
        stripped = line.strip()
        title = HEADING_LINE.match(stripped)
        is_row = stripped.startswith("|")
        if not title and not is_row:
            prose_from = offset if prose_from is None else prose_from
            header = header if stripped else None
            continue
        yield from prose(offset)
        prose_from = None
        end = offset + len(line.rstrip())
        if title:
            level = len(title.group(1))
            path = {depth: name for depth, name in path.items() if depth < level} | {level: title.group(2).strip()}
            header = None
            yield Unit(offset, end, stripped, section(), None, True)
        elif header is None or not TABLE_RULE.fullmatch(stripped):
            header = stripped if header is None else header
            yield Unit(offset, end, stripped, section(), header)
    yield from prose(len(text))


def _split_long(units: list[Unit], limit: int) -> Iterator[Unit]:
    for unit in units:
        if len(unit.text) <= limit:
            yield unit
        else:
            for begin, end in window_spans(unit.text, limit, 0):
                yield unit._replace(start=unit.start + begin, end=unit.start + end, text=unit.text[begin:end].strip())


def _ranges(units: list[Unit], weight: list[int], cfg: TextPreparation) -> Iterator[tuple[int, int]]:
    """Greedy passages as unit ranges [low, high): one section each, whole-sentence overlap between neighbours.

    ``weight`` is the prefix sum of unit length + 1, so the size of any range is one subtraction.
    """
    low = 0
    for i, unit in enumerate(units[1:], 1):
        same = unit.section == units[i - 1].section
        if same and weight[i] - weight[low] + len(unit.text) <= cfg.max_chars:
            continue
        yield low, i
        restart = i
        if same and cfg.overlap_chars:
            # the earliest unit whose range up to here, without the last separator, fits the overlap budget
            restart = bisect_left(weight, weight[i] - cfg.overlap_chars - 1, low, i)
            blocked = [j for j in range(restart, i) if units[j].heading]
            restart = blocked[-1] + 1 if blocked else restart
        low = restart if weight[i] - weight[restart] + len(unit.text) <= cfg.max_chars else i
    if units:
        yield low, len(units)


def pack_units(units: list[Unit], cfg: TextPreparation) -> list[Passage]:
    """Pack whole units into passages; short tails join the passage before them, bare headings are dropped."""
    units = list(_split_long(units, cfg.max_chars))
    weight = [0, *accumulate(len(u.text) + 1 for u in units)]
    roof = int(cfg.max_chars * TAIL_STRETCH)
    packed: list[tuple[int, int]] = []
    for low, high in _ranges(units, weight, cfg):
        if packed:
            first, last = packed[-1]
            fresh = weight[high] - weight[last]
            if (fresh < cfg.tail_chars and units[high - 1].section == units[last - 1].section
                    and weight[last] - weight[first] + fresh <= roof):
                packed[-1] = (first, high)
                continue
        packed.append((low, high))
    return [_passage(units[low:high]) for low, high in packed if _worth_keeping(units[low:high])]


def _worth_keeping(run: list[Unit]) -> bool:
    return any(u.text.strip() for u in run) and not all(u.heading for u in run)


def _passage(run: list[Unit]) -> Passage:
    body = "\n".join(u.text for u in run)
    header = run[0].header
    if header and run[0].text != header:  # starts inside a table: repeat its column names
        body = f"{header}\n{body}"
    return Passage(run[0].start, run[-1].end, run[-1].section[:SECTION_CHARS] or None, body)


def fixed_passages(text: str, cfg: TextPreparation) -> list[Passage]:
    return [Passage(s, e, None, text[s:e].strip()) for s, e in window_spans(text, cfg.max_chars, cfg.overlap_chars)]


def structure_passages(text: str, cfg: TextPreparation, markdown: bool = True) -> list[Passage]:
    return pack_units(list(markdown_units(text) if markdown else sentence_units(text)), cfg)


def text_passages(text: str, cfg: TextPreparation, markdown: bool = True) -> list[Passage]:
    """Passages by the profile's strategy. Callers may plug in any function of this shape (see ``chunk_with``)."""
    return structure_passages(text, cfg, markdown) if cfg.strategy == "structure" else fixed_passages(text, cfg)


PASSAGE_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("section", pa.string()), ("content", pa.string())]
PASSAGE_DDL = "`start` int, `end` int, section string, content string"


def explode_texts(df: DataFrame, text: str, split: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType]],
                  ddl: str) -> DataFrame:
    """Run ``split`` on every text and explode its tuples; the other columns are repeated by an Arrow take."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep] + [ddl])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, text)):
            source, rows = [], []
            for i, value in enumerate(batch.column(text)):
                if value.is_valid:
                    found = split(value.as_py())
                    source.extend([i] * len(found))
                    rows.extend(found)
            take = pa.array(source, pa.int64())
            columns = [batch.column(c).take(take) for c in keep]
            values = list(zip(*rows)) if rows else [[] for _ in fields]
            columns += [pa.array(list(v), kind) for v, (_, kind) in zip(values, fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(n for n, _ in fields)])

    return dealt(df, text).mapInArrow(kernel, schema)


def chunk_with(df: DataFrame, text: str, chunker: Callable[[str], list[Passage]]) -> DataFrame:
    """Passages of any chunker: a function from text to ``Passage`` rows."""
    return explode_texts(df, text, chunker, PASSAGE_FIELDS, PASSAGE_DDL)


def chunk_fixed(df: DataFrame, text: str = "text", max_chars: int = 1600, overlap_chars: int = 200) -> DataFrame:
    """Fixed windows with overlap: every other column of ``df`` plus start, end, section, content."""
    cfg = TextPreparation("fixed", max_chars, overlap_chars)
    return chunk_with(df, text, lambda value: fixed_passages(value, cfg))


def chunk_structure(df: DataFrame, text: str = "text", cfg: TextPreparation | None = None,
                    markdown: bool = True) -> DataFrame:
    """Structure-aware passages of whole sentences, table rows and headings."""
    cfg = cfg or TextPreparation("structure", 1200, 200, 250)
    return chunk_with(df, text, lambda value: structure_passages(value, cfg, markdown))


UNIT_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("section", pa.string()),
               ("header", pa.string()), ("heading", pa.bool_())]
UNIT_DDL = "`start` int, `end` int, text string, section string, header string, heading boolean"


def units_of(df: DataFrame, text: str = "text", markdown: bool = True) -> DataFrame:
    """Units of every text as rows."""
    split = markdown_units if markdown else sentence_units
    return explode_texts(df, text, lambda value: list(split(value)), UNIT_FIELDS, UNIT_DDL)
