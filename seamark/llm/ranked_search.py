"""Ranked lexical search of all documents by MaxScore with pair bounds.

The index is partitioned by documents: each task turns the documents it reads into shards of bounded size with the
postings of the asked terms, so no text is shuffled. Beside the largest impact of each term in each block of documents, a
shard stores, for pairs of terms that are neighbours in some question, the largest joint impact of the documents that hold
both, block by block. At query time the bound of a question's remaining terms is the least over all ways of covering them
by single terms and stored pairs, which is tighter than the sum of their maxima; postings and candidates below the tenth
best score are skipped. The tenth largest of a pair's block maxima, over all shards, is a score that ten documents reach,
so every task starts with a threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.llm.common import UPPER, LOWER, shared_table

SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000  # of a shard, which is one row of the index
BLOCK = 256                                   # documents that share the stored maxima
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 16_000_000  # of the questions that travel with the tasks at a time
TOP = 10

# Words are what bytes other than these leave: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, with A-Z lower-cased.
_BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
WORD_BYTES = bytes.maketrans(_BETWEEN + UPPER.encode(), b" " * len(_BETWEEN) + LOWER.encode())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Questions:
    """A block of items as term numbers, and what the whole corpus says about these terms."""

    items: list             # (item_id, distinct terms)
    vocabulary: dict        # term -> number
    documents: int = 0      # N
    length: int = 0         # L
    weights: np.ndarray | None = None
    chains: list | None = None  # per item its terms, the heaviest first
    pairs: dict | None = None   # (term, term) of neighbours in a chain -> number

    def weighed(self, documents: int, length: int, df: np.ndarray) -> Questions:
        """With w = floor(1000 * ln((2N + 2) / (2df + 1))), chains by falling weight and their neighbours."""
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        chains = [sorted((t for t in terms if df[t] and weights[t] > 0), key=lambda t: (-weights[t], t)) for _, terms in self.items]
        pairs: dict = {}
        for chain in chains:
            for pair in zip(chain, chain[1:]):
                pairs.setdefault(pair, len(pairs))
        return Questions(self.items, self.vocabulary, documents, length, weights, chains, pairs)


def ask(rows: list) -> Questions:
    vocabulary: dict = {}
    items = [(key, {vocabulary.setdefault(w, len(vocabulary)) for w in words_of((text or "").encode())}) for key, text in rows]
    return Questions([i for i in items if i[1]], vocabulary)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    for value in batch.column(at):
        yield value.as_py() or b""


def statistics(docs: DataFrame, asked: Questions, text: str) -> tuple[int, int, np.ndarray]:
    """(N, L, df by term number) in one pass; only sums by term reach the driver."""
    shipped = docs.sparkSession.sparkContext.broadcast(asked.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df, documents, length = shipped.value.get, Counter(), 0, 0
        for batch in batches:
            for body in _texts(batch, 0):
                words = words_of(body)
                documents, length = documents + bool(words), length + len(words)
                df.update(set(map(get, words)))
        del df[None]
        rows = [(-1, documents), (-2, length), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["term", "n"])

    found = docs.select(F.col(text).cast("binary")).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r["term"]: r["n"] for r in found.collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(len(asked.vocabulary))], np.int64)


# One shard: documents; terms with the ends of their postings; postings as places and impacts without weight; the largest
# impact of key, block (a key below the number of pairs is a pair, then terms follow).
SHARD = ["docs", "terms", "ends", "slots", "parts", "keys", "blocks", "most"]
SHARD_TYPES = dict(zip(SHARD, ["<i8", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i8"]))
SHARD_ROW = ", ".join(f"{c} binary" for c in SHARD)


def block_maxima(slots: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, largest impact) of ascending slots."""
    blocks = slots // BLOCK
    starts = np.flatnonzero(np.diff(blocks, prepend=-1))
    return blocks[starts], np.maximum.reduceat(impacts, starts)


def build_shard(docs: list[int], lengths: list[int], sizes: list[int], terms: list[int], freqs: list[int], asked: Questions) -> dict:
    """The arrays of ``SHARD`` from the documents' word counts, numbers of asked terms and (term, occurrences) in turn."""
    n, tf = np.array(lengths, np.int64), np.array(freqs, np.int64)
    m = 100 - 90 + (90 * n * asked.documents) // max(asked.length, 1)
    slots, term = np.repeat(np.arange(len(docs)), sizes), np.array(terms, np.int64)
    parts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[slots]) if len(tf) else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    slots, term, parts = slots[order], term[order], parts[order]
    impacts = parts * asked.weights[term]
    present, starts = np.unique(term, return_index=True)
    ends = np.append(starts[1:], len(term))
    span = {t: (a, b) for t, a, b in zip(present.tolist(), starts.tolist(), ends.tolist())}
    keys, blocks, most = [], [], []

    def keep(key: int, at: np.ndarray, impact: np.ndarray) -> None:
        where, largest = block_maxima(at, impact)
        keys.append(np.full(len(where), key)), blocks.append(where), most.append(largest)

    for t, (a, b) in span.items():
        keep(len(asked.pairs) + t, slots[a:b], impacts[a:b])
    by_first: dict = {}
    for (a, b), key in asked.pairs.items():
        if a in span and b in span:
            by_first.setdefault(a, []).append((b, key))
    held = np.zeros(len(docs), np.int64)
    for a, others in by_first.items():
        since, until = span[a]
        held[slots[since:until]] = impacts[since:until]
        for b, key in others:
            since_b, until_b = span[b]
            own = held[slots[since_b:until_b]]
            both = np.flatnonzero(own)
            if len(both):
                keep(key, slots[since_b:until_b][both], own[both] + impacts[since_b:until_b][both])
        held[slots[since:until]] = 0
    join = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    values = [np.array(docs, np.int64), present, ends, slots, parts, join(keys), join(blocks), join(most)]
    return {c: v.astype(SHARD_TYPES[c]) for c, v in zip(SHARD, values)}


def build_index(docs: DataFrame, asked: Questions, doc_id: str, text: str) -> DataFrame:
    """Rows of ``SHARD``: every document with an asked term, in shards of what one task reads."""
    shipped = docs.sparkSession.sparkContext.broadcast(asked)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shipped.value
        get, ids, lengths, sizes, terms, freqs = questions.vocabulary.get, [], [], [], [], []

        def shard() -> pa.RecordBatch:
            arrays = build_shard(ids, lengths, sizes, terms, freqs, questions)
            for held in (ids, lengths, sizes, terms, freqs):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([arrays[c].tobytes()], pa.binary()) for c in SHARD], names=SHARD)

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                words = words_of(body)
                found = Counter(map(get, words))
                found.pop(None, None)
                if found:
                    ids.append(key), lengths.append(len(words)), sizes.append(len(found))
                    terms.extend(found.keys()), freqs.extend(found.values())
                    if len(ids) >= SHARD_DOCS or len(terms) >= SHARD_POSTINGS:
                        yield shard()
        if ids:
            yield shard()

    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).cast("bigint"), F.col(text).cast("binary")).mapInArrow(index, SHARD_ROW)


def first_thresholds(index: DataFrame, asked: Questions, k: int) -> np.ndarray:
    """Per item a score that k documents reach: the k-th largest block maximum of one of its pairs or terms. Blocks are
    disjoint, so k maxima belong to k documents. One row per pair and term reaches the driver."""
    schema = "key int, most bigint"

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, most in zip(batch.column(0), batch.column(1)):
                keys, most = np.frombuffer(keys.as_buffer(), "<i4"), np.frombuffer(most.as_buffer(), "<i8")
                order = np.lexsort((-most, keys))
                keys, most = keys[order], most[order]
                rank = np.arange(len(keys)) - np.searchsorted(keys, keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[rank < k]), pa.array(most[rank < k])], names=["key", "most"])

    along = W.partitionBy("key").orderBy(F.col("most").desc())
    kth = index.select("keys", "most").mapInArrow(largest, schema).withColumn("r", F.row_number().over(along)).where(F.col("r") <= k)
    reached = np.zeros(len(asked.pairs) + len(asked.vocabulary), np.int64)
    for r in kth.where(F.col("r") == k).select("key", "most").collect():
        reached[r["key"]] = r["most"]
    return np.array([max([reached[len(asked.pairs) + t] for t in c] + [reached[asked.pairs[p]] for p in zip(c, c[1:])], default=0)
                     for c in asked.chains], np.int64)


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, asked: Questions):
        self.asked = asked
        for c in SHARD:
            setattr(self, c, np.frombuffer(row[c], SHARD_TYPES[c]))
        starts = np.concatenate([[0], self.ends[:-1]]).astype(int)
        self.span = {t: slice(a, b) for t, a, b in zip(self.terms.tolist(), starts.tolist(), self.ends.tolist())}
        self.block_of = np.arange(len(self.docs)) // BLOCK
        self.bounds = np.zeros((len(asked.pairs) + len(asked.vocabulary), (len(self.docs) + BLOCK - 1) // BLOCK), np.int64)
        self.bounds[self.keys, self.blocks] = self.most
        self.read = 0  # postings read so far

    def rest_bounds(self, chain: list[int], with_pairs: bool = True) -> np.ndarray:
        """Row i: per block, what the terms from the i-th on can add at most."""
        pairs, alone = self.asked.pairs, self.bounds[[len(self.asked.pairs) + t for t in chain]]
        rest = np.zeros((len(chain) + 1, self.bounds.shape[1]), np.int64)
        for i in range(len(chain) - 1, -1, -1):
            rest[i] = alone[i] + rest[i + 1]
            pair = pairs.get((chain[i], chain[i + 1])) if with_pairs and i + 1 < len(chain) else None
            if pair is not None:
                both = np.maximum(np.maximum(alone[i], alone[i + 1]), self.bounds[pair])
                rest[i] = np.minimum(rest[i], both + rest[i + 2])
        return rest

    def search(self, chain: list[int], k: int, threshold: int, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the k best, given that k documents reach ``threshold``."""
        chain = [t for t in chain if t in self.span]
        rest = self.rest_bounds(chain, with_pairs)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        live = rest[0] >= max(threshold, 1)
        if not live.any():
            return nothing
        scores, at = np.zeros(len(self.docs), np.int64), 0
        while at < len(chain) and (rest[at][live] >= threshold).any():  # documents that start here can still get in
            span = self.span[chain[at]]
            scores[self.slots[span]] += self.parts[span] * self.asked.weights[chain[at]]
            self.read += span.stop - span.start
            at += 1
            if at == 3 and len(scores) > k:
                threshold = max(threshold, int(np.partition(scores, -k)[-k]))
        some = np.flatnonzero((scores > 0) & live[self.block_of])
        some = some[scores[some] + rest[at][self.block_of[some]] >= threshold]
        for i in range(at, len(chain)):
            if not len(some):
                return nothing
            span = self.span[chain[i]]
            slots = self.slots[span]
            place = np.minimum(np.searchsorted(slots, some), len(slots) - 1)
            hit = slots[place] == some
            scores[some[hit]] += self.parts[span][place[hit]] * self.asked.weights[chain[i]]
            self.read += int(hit.sum())
            some = some[scores[some] + rest[i + 1][self.block_of[some]] >= threshold]
        return best(self.docs[some], scores[some], k)


def best(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by ascending document."""
    order = np.lexsort((docs, -scores))
    order = order[scores[order] > 0][:k]
    return docs[order], scores[order]


def search_index(index: DataFrame, asked: Questions, thresholds: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): at most k rows per item and task."""
    shipped = index.sparkSession.sparkContext.broadcast((asked, thresholds))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, start = shipped.value
        reached, found = start.copy(), {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, questions)
                for i, chain in enumerate(questions.chains):
                    docs, scores = shard.search(chain, k, int(reached[i]))
                    if len(docs):
                        if i in found:
                            docs, scores = best(np.concatenate([found[i][0], docs]), np.concatenate([found[i][1], scores]), k)
                        found[i] = docs, scores
                        if len(docs) == k:
                            reached[i] = max(reached[i], scores[-1])
        for i, (docs, scores) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i), pa.int32()), pa.array(docs), pa.array(scores)], schema=schema)

    return index.mapInArrow(search, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, equal scores by ascending doc_id.

    Items are distinct rows of ``items``; many of them are asked in blocks that travel with the tasks, each with an index of
    its terms. Items and texts that are null or have no words find and are nothing; documents without an id are counted
    but never found; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    asking = shared_table(items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).distinct(), "items")
    size = asking.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    results = []
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        asked = ask([(r["item_id"], r["text"]) for r in part.collect()])  # about BLOCK_ITEMS rows, BLOCK_CHARS characters
        asked = asked.weighed(*statistics(docs, asked, text))
        index = shared_table(build_index(docs, asked, doc_id, text), "index")
        hits = search_index(index, asked, first_thresholds(index, asked, k), k)
        along = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        ranked = hits.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(asked.items)], "item int, item_id bigint")
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return results[0] if blocks == 1 else shared_union(results)


def shared_union(results: list[DataFrame]) -> DataFrame:
    """Blocks of results as one table; each is stored first, so the plan stays small."""
    stored = [shared_table(r, "ranked") for r in results]
    whole = stored[0]
    for r in stored[1:]:
        whole = whole.unionByName(r)
    return whole
