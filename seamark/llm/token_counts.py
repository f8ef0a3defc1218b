"""Token counts of every prefix of a text, by dynamic programming over the vocabulary.

A sequence of byte-level BPE tokens is the encoding of its bytes exactly if every two neighbours encode to themselves.
So the encoding of each prefix of a piece is that of a shorter prefix and one more token: of all tokens that end at a
place (found by an Aho-Corasick automaton) just one fits the last token of the prefix before it. One pass over a text
gives the count of every prefix; they are stored as differences, and questions about truncation and budgets read them
without encoding again. Counts may fall as a prefix grows, where a longer token joins shorter ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.llm.tokens import CHUNKS, PRETOKENS, Encoder

PAIRS = 2_000_000          # pairs of neighbouring tokens that a worker remembers; a full memory is emptied
OUTPUT_BYTES = 16_000_000  # of a batch that leaves a task
TABLE = "doc_id bigint, n_bytes bigint, width int, deltas binary"
_TABLE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int32()), ("deltas", pa.binary())])

# What the split pattern's \s means, and its contractions that have a prefix of two pieces.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Counts for the prefixes of whole texts, each equal to encoding that prefix alone with the library's defaults:
    no tokens added, strings of special tokens taken as these tokens."""

    def __init__(self, path: str):
        from ahocorasick import Automaton
        base = Encoder(path)
        self.split, self.alphabet, self.model = base.split, base.alphabet, base.model
        added = [t for t in base.tokenizer.get_added_tokens_decoder().values()]
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or r"(?!)")
        vocabulary = base.tokenizer.get_vocab(with_added_tokens=False)
        self.written = {t: s for s, t in vocabulary.items()}
        self.tokens = Automaton()
        for s, t in vocabulary.items():
            if self._ids(s) == [t]:
                self.tokens.add_word(s, (t, len(s)))
        self.tokens.make_automaton()
        self.cut = re.compile(f"(?<=[^{SPACES}])(?= [^{SPACES}])")
        self.spaces = frozenset(SPACES)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, object] = {}

    def _ids(self, written: str) -> list[int]:
        return [t.id for t in self.model.tokenize(written)]

    def _fit(self, pair: int) -> bool:
        """Whether the two tokens of ``pair`` (32 bits each) encode to themselves when one follows the other."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        a, b = pair >> 32, pair & 0xFFFFFFFF
        known = self.pairs[pair] = self._ids(self.written[a] + self.written[b]) == [a, b]
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """The count of each prefix, in characters, of a piece that the split pattern does not cut."""
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) > PRETOKENS:
                self.pieces.clear()
            known = self.pieces[piece] = self._count(piece)
        return known

    def _count(self, piece: str) -> list[int]:
        raw = piece.encode()
        written = raw.decode("latin1").translate(self.alphabet)
        last, count = [0] * (len(written) + 1), [0] * (len(written) + 1)
        pairs, fit = self.pairs, self._fit
        for at, (token, size) in self.tokens.iter(written):
            at += 1
            if not count[at]:
                since = at - size
                if since:
                    key = last[since] << 32 | token
                    if not (pairs[key] if key in pairs else fit(key)):
                        continue
                last[at], count[at] = token, count[since] + 1
        if len(raw) == len(piece):
            return count[1:]
        ends = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80][1:]
        return [count[e] for e in ends] + count[-1:]

    def _chunk(self, chunk: str) -> bytes | tuple[np.ndarray]:
        """Differences of the counts of a stretch that begins a text or follows a character other than white space: one
        byte each, or a boxed array where one does not fit."""
        pieces = self.split(chunk)
        if len(pieces) == 1 and chunk[-1] not in self.spaces and chunk not in CONTRACTIONS:
            return _packed(self._count(chunk))  # the chunk itself is remembered
        counts, base, at = [], 0, 0
        for piece in pieces:
            own = self.piece_counts(piece)
            if piece in CONTRACTIONS:
                own = [own[0], own[0] + self.piece_counts(piece[1])[0], own[2]]
            if piece[0] in self.spaces and len(counts) == at:
                # a prefix that ends in a run of white space has all of it in one piece, the whole text may not
                end = at + 1
                while end < len(chunk) and chunk[end] in self.spaces:
                    end += 1
                if end > at + 1:
                    counts += [base + c for c in self.piece_counts(chunk[at:end])]
            counts += [base + c for c in own[len(counts) - at:]]
            base, at = base + own[-1], at + len(piece)
        return _packed(counts)

    def _plain(self, text: str) -> list:
        """Differences, in parts, of a text without special tokens."""
        head, *rest = text.split(" ")
        chunks, known = self.chunks, self.chunks
        try:
            found = [known[c] for c in rest]
        except KeyError:
            if len(chunks) > CHUNKS:
                chunks.clear()
            for c in set(rest).difference(chunks):
                chunks[c] = None if not c or c[0] in self.spaces or c[-1] in self.spaces else self._chunk(" " + c)
            found = [known[c] for c in rest]
        if None in found or (head and head[-1] in self.spaces):
            return [self._chunk(c) for c in self.cut.split(text) if c]
        return ([self._chunk(head)] if head else []) + found

    def deltas(self, text: str) -> tuple[int, bytes]:
        """(width, differences): the count of each prefix less that of the one before, ``width`` bytes each."""
        parts, at = [], 0
        for m in self.special.finditer(text):
            # the token ends what comes before it; up to its last character it is ordinary text
            before = self._plain(text[at:m.start()]) if m.start() > at else []
            partly = _join(self._plain(text[at:m.end() - 1]))
            total = int(_join(before)[1].sum(dtype=np.int64)) + 1
            parts += [partly[0], (np.array([total - int(partly[1].sum(dtype=np.int64))], np.int32),)]
            at = m.end()
        if at < len(text):
            parts += self._plain(text[at:])
        try:
            return 1, b"".join(parts)
        except TypeError:
            values = _join(parts)[1].astype(np.int32)
            small = values.astype(np.int8)
            return (1, small.tobytes()) if (small == values).all() else (4, values.astype("<i4").tobytes())


def _packed(counts: list[int]) -> bytes | tuple[np.ndarray]:
    steps = list(map(sub, counts, [0, *counts]))
    try:
        return array("b", steps).tobytes()
    except OverflowError:
        return (np.array(steps, np.int32),)


def _join(parts: list) -> tuple[object, np.ndarray]:
    """All parts as one part and as an array."""
    arrays = [p[0] if isinstance(p, tuple) else np.frombuffer(p, np.int8) for p in parts]
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int8)
    return (values,), values


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """One per worker process and file."""
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, width, deltas): the token count of every prefix of every whole text; write it, then ask.

    ``deltas`` holds one little-endian signed integer of ``width`` bytes per character: the count of the prefix that ends
    there less that of the prefix before. A null text is an empty one, with no entries. Repeated rows are counted as often
    as they come; a null doc_id stays null; very long texts and pieces take time in proportion to their length; an empty
    table gives no rows; other columns are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas, rows, held = counter(tokenizer).deltas, [], 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for key, size, body in zip(batch.column(0).to_pylist(), sizes, batch.column(1)):
                rows.append((key, size, *deltas(body.as_py() or "")))
                held += len(rows[-1][3])
                if held > OUTPUT_BYTES or len(rows) >= 8192:
                    yield _batch(rows, _TABLE)
                    rows, held = [], 0
        yield _batch(rows, _TABLE)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, TABLE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def counts_of(width: int, deltas: bytes) -> np.ndarray:
    """The token count of each prefix of 0, 1, 2, ... characters."""
    steps = np.frombuffer(deltas, np.int8 if width == 1 else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def token_totals(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the whole texts of a stored prefix table, one row per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def total(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3))
            sums = [int(np.frombuffer(d.as_buffer(), np.int8 if w == 1 else "<i4").sum(dtype=np.int64)) for w, d in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], schema=schema)

    return stored.select("doc_id", "n_bytes", "width", "deltas").mapInArrow(total, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def longest_prefixes(stored: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, tokens): where to truncate each text so that its encoding has at most ``budget`` tokens and no
    longer prefix has as few. Counts are not monotone, so the last such prefix is taken; 0 characters always fit."""
    if budget < 0:
        raise ValueError("a budget is not negative")
    schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("tokens", pa.int64())])

    def truncate(batches):
        for batch in batches:
            out = []
            for key, width, deltas in zip(*(c.to_pylist() for c in batch.columns)):
                counts = counts_of(width, deltas)
                at = int(np.flatnonzero(counts <= budget)[-1])
                out.append((key, at, int(counts[at])))
            yield _batch(out, schema)

    return stored.select("doc_id", "width", "deltas").mapInArrow(truncate, "doc_id bigint, chars bigint, tokens bigint")


def tokens_before(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, chars, tokens) for the distinct questions ``asked(doc_id, chars)``: tokens of the first ``chars`` characters.

    Null tokens where the text is shorter; questions about unknown or null documents or places are left out. A document's
    questions are one array, of at most one entry per place of its text, so a table row meets them once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("tokens", pa.int64())])
    places = asked.where("doc_id is not null and chars >= 0").groupBy("doc_id").agg(F.collect_set(F.col("chars").cast("bigint")).alias("places"))

    def answer(batches):
        for batch in batches:
            out = []
            for key, width, deltas, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                counts = counts_of(width, deltas)
                out += [(key, at, int(counts[at]) if at < len(counts) else None) for at in wanted]
            yield _batch(out, schema)

    return stored.join(places, "doc_id").select("doc_id", "width", "deltas", "places").mapInArrow(
        answer, "doc_id bigint, chars bigint, tokens bigint")
