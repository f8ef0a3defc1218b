"""Packing examples into fixed-length sequences under several limits at once: vector bin packing by dot products.

An item is a vector (tokens, one segment, loss-bearing tokens). A sequence takes, among the items that still fit all
limits, the one whose vector has the largest dot product with what is left of the sequence (Panigrahy et al., 2011). If
none fits and cutting is allowed, the best of the others is cut to fill it. Tasks pack what they read, so nothing is
shuffled; a task holds at most ``WINDOW`` items shorter than a sequence, and splits what is left at its end into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seamark.llm.tokens import CHUNKS, PRETOKENS, encoder

WINDOW = 4096
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, "
          "sequence_id bigint, offset bigint, segment int, ids binary")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


@dataclass
class Item:
    """A piece of an example; ``loss`` is how many of its tokens bear loss, all or none of them if it may be cut."""

    owner: object
    start: int
    length: int
    loss: int
    cuttable: bool = True

    def cut(self, length: int) -> tuple[Item, Item]:
        head = Item(self.owner, self.start, length, length if self.loss else 0)
        return head, Item(self.owner, self.start + length, self.length - length, self.length - length if self.loss else 0)


@dataclass
class Pool:
    """Items by kind (length, loss, cuttable), so that a choice looks at each kind once."""

    kinds: dict[tuple, list[Item]] = field(default_factory=dict)
    size: int = 0
    tokens: int = 0

    def add(self, item: Item) -> None:
        self.kinds.setdefault((item.length, item.loss, item.cuttable), []).append(item)
        self.size += 1
        self.tokens += item.length

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = np.array(list(self.kinds), dtype=np.int64).reshape(-1, 3)
        return keys[:, 0], keys[:, 1], keys[:, 2].astype(bool), np.array([len(v) for v in self.kinds.values()])

    def rebuilt(self) -> list[tuple]:
        self.kinds = {k: v for k, v in self.kinds.items() if v}
        return list(self.kinds)


def fill(pool: Pool, limits: Limits, tokens: int, until: int) -> Iterator[list[Item]]:
    """Sequences of up to ``tokens`` tokens from the pool until at most ``until`` items are left."""
    caps = np.array([tokens, limits.segments, limits.loss], float)
    while pool.size > until:
        names = pool.rebuilt()
        length, loss, cuttable, count = pool.arrays()
        demand = np.stack([length / caps[0], np.full(len(length), 1 / caps[1]), loss / caps[2]])
        weight = (demand * count).sum(1)  # scarce limits count more
        for _ in range(64):  # sequences per look at the kinds
            rest, sequence = caps.copy(), []
            while rest[1] >= 1 and rest[0] >= 1 and count.any():
                worth = (weight * rest / caps) @ demand
                live = count > 0
                fits = live & (length <= rest[0]) & (loss <= rest[2])
                room = int(min(rest[0], rest[2]))
                if fits.any():
                    k = int(np.argmax(np.where(fits, worth, -1.0)))
                    item = pool.kinds[names[k]].pop()
                    count[k] -= 1
                    pool.size -= 1
                    pool.tokens -= item.length
                elif room and (live & cuttable & (length > room)).any():
                    k = int(np.argmax(np.where(live & cuttable & (length > room), worth, -1.0)))
                    whole = pool.kinds[names[k]].pop()
                    pool.size -= 1
                    pool.tokens -= whole.length
                    item, left = whole.cut(room)
                    pool.add(left)
                    count[k] -= 1
                    if (key := (left.length, left.loss, left.cuttable)) in names:
                        count[names.index(key)] += 1
                else:
                    break
                sequence.append(item)
                rest -= (item.length, 1, item.loss)
            if sequence:
                yield sequence
            if pool.size <= until or not count.any():
                break
        else:
            continue


class Packer:
    """Packs a stream of items; ``add`` and ``finish`` yield sequences, lists of items in their order."""

    def __init__(self, limits: Limits):
        self.limits, self.pool = limits, Pool()

    def add(self, item: Item) -> Iterator[list[Item]]:
        while item.cuttable and item.length > (most := min(self.limits.tokens, self.limits.loss if item.loss else item.length)):
            head, item = item.cut(most)
            if most == self.limits.tokens:
                yield [head]
            else:
                self.pool.add(head)
        if item.length > self.limits.tokens or item.loss > self.limits.loss:
            raise ValueError(f"an example of {item.length} tokens ({item.loss} with loss) may not be cut and fits no sequence")
        if item.length == self.limits.tokens:
            yield [item]
        elif item.length:
            self.pool.add(item)
        if self.pool.size >= WINDOW:
            yield from fill(self.pool, self.limits, self.limits.tokens, WINDOW // 8)

    def finish(self) -> Iterator[list[Item]]:
        while self.pool.size:
            if self.pool.tokens >= self.limits.tokens or not all(k[2] for k, v in self.pool.kinds.items() if v):
                size = self.limits.tokens
            else:
                size = 1 << (self.pool.tokens.bit_length() - 1)
            before = self.pool.size, self.pool.tokens
            for sequence in fill(self.pool, self.limits, size, 0):
                yield sequence
                if self.pool.tokens < size:
                    break
            assert (self.pool.size, self.pool.tokens) != before


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), with_ids: bool = False,
                   doc_id: str = "doc_id", text: str = "text", loss: str | None = None, remembered: float = 1.0) -> DataFrame:
    """One row per piece of a document's ids (``PIECES``): its place in the document and in its sequence.

    ``tokenizer`` is the path of a byte-level vocabulary on every machine. Each document ends with ``end_id``, so null and
    empty texts are one token. ``loss`` names a boolean column: whether a document's tokens bear loss (null: they do).
    Documents may be cut anywhere. Repeated rows are packed as often as they come; a null doc_id stays null; an empty
    table gives no rows; other columns are not read. ``remembered`` is the share of the encoder's usual memory of words: less
    of it takes more time, and is given back after each task. A sequence is padded up to ``limits.tokens`` unless its length is a
    power of two.
    """
    bears = F.coalesce(F.col(loss), F.lit(True)) if loss else F.lit(True)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), bears.alias("loss"))
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = int(CHUNKS * remembered), int(PRETOKENS * remembered)
        coder, packer, out = encoder(tokenizer, *known), Packer(limits), _Output(with_ids)
        encode = coder.encode
        for batch in batches:
            for key, body, bearing in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(body) + end
                n = len(ids) // 4
                for sequence in packer.add(Item((key, ids, n), 0, n, n if bearing else 0)):
                    out.add(sequence)
                if len(out.rows) >= 8192:
                    yield out.batch()
        for sequence in packer.finish():
            out.add(sequence)
        if remembered < 1:
            coder.forget()
        yield out.batch()

    return rows.mapInArrow(pack, PIECES)


class _Output:
    SCHEMA = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t])
                        for n, t in (c.split() for c in PIECES.split(", "))])

    def __init__(self, with_ids: bool):
        self.rows, self.with_ids = [], with_ids
        self.sequence = TaskContext.get().partitionId() << 36

    def add(self, sequence: list[Item]) -> None:
        at = 0
        for k, item in enumerate(sequence):
            key, ids, n = item.owner
            own = ids[4 * item.start:4 * (item.start + item.length)]
            self.rows.append((key, item.start, item.length, zlib.crc32(own), n, item.loss, self.sequence, at, k,
                              own if self.with_ids else None))
            at += item.length
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.SCHEMA)], schema=self.SCHEMA)


def padding(pieces: DataFrame, tokens: int = 1024) -> DataFrame:
    """One row: sequences, tokens, padding tokens and their share."""
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n") == F.pow(F.lit(2.0), F.round(F.log2("n"))).cast("bigint")
    return sequences.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"),
                         F.sum(F.when(power, 0).otherwise(tokens - F.col("n"))).alias("padding")).withColumn(
        "share", F.col("padding") / (F.col("padding") + F.col("tokens")))
