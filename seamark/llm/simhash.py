"""SimHash near-duplicates: fingerprints linked within a Hamming radius through vantage-point trees.

The 64 bits are cut into ``slices``; a pair within ``radius`` differs by at most radius // slices bits in one of them.
Each slice has its own vantage-point tree over the Hamming distance of that slice: a node sends a fingerprint to the near
or the far branch, and a copy of it across the threshold where the triangle inequality cannot rule a partner out. Leaves
are shards; a shard compares the fingerprints that live there with each other and with the copies sent there, on all 64
bits. So every pair within the radius meets in some shard, whatever the tree looks like; the sample a tree is grown from
only sets how even the shards are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from seamark.llm.common import WHITE_SPACE, ascii_lower, shared_table, split_words
from seamark.llm.components import components

SAMPLE = 100_000   # fingerprints that the trees are grown from, at most
LEAF = 4096        # fingerprints aimed at in a shard
CELL = 8192        # owners, and visitors, that one task compares at a time
SPAN = 65_536      # shingle hashes whose bits are spread out at a time


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    w = split_words(ascii_lower(text), WHITE_SPACE)
    return w, lambda w: (
        F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(
            F.concat_ws(" ", *(F.get(w, i + k) for k in range(words))))))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))
        .otherwise(F.array().cast("array<bigint>")))


def majority_bits(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per row, the 64-bit value whose bits are set in more than half of the row's hashes; 0 for a row without any."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    counts = np.zeros((len(ends), 64), np.int64)
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(ends)), ends - starts)
    for at in range(0, len(raw), SPAN):
        bits = np.unpackbits(raw[at:at + SPAN], axis=1, bitorder="little")
        rows = row[at:at + SPAN]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    major = (2 * counts > (ends - starts)[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


@F.arrow_udf(LongType())
def _fingerprint(hashes: pa.Array) -> pa.Array:
    offsets = hashes.offsets.to_numpy()
    values = hashes.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return pa.array(majority_bits(values, offsets[1:] - offsets[0]).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with ``fp`` bigint instead of its text. Null, empty and blank texts have fingerprint 0."""
    others = [c for c in docs.columns if c != text]
    prepared, hashes = shingle_hashes(F.col(text), words)
    split = docs.select(*others, prepared.alias("__words"))
    return split.select(*others, _fingerprint(hashes(F.col("__words"))).alias("fp"))


@dataclass
class Tree:
    """A vantage-point tree in arrays; node i sends distance <= cut[i] to near[i], others to far[i]; a leaf has near -1."""

    mask: int
    radius: int
    vantage: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray


def grow_tree(sample: np.ndarray, mask: int, radius: int, leaf: int) -> Tree:
    """Split at the median distance to the vantage point that spreads the sample most, until ``leaf`` points are left."""
    vantage, cut, near, far = [], [], [], []
    work = [(sample, -1, False)]
    while work:
        points, parent, is_far = work.pop()
        me = len(vantage)
        if parent >= 0:
            (far if is_far else near)[parent] = me
        vantage.append(np.uint64(0)), cut.append(0), near.append(-1), far.append(-1)
        if len(points) <= leaf:
            continue
        tries = points[:: max(1, len(points) // 8)][:8]
        spread = [np.var(np.bitwise_count((points ^ v) & np.uint64(mask))) for v in tries]
        best = tries[int(np.argmax(spread))]
        d = np.bitwise_count((points ^ best) & np.uint64(mask))
        t = int(np.median(d))
        if (d <= t).all():
            t -= 1
        inside = d <= t
        if not inside.any():
            continue
        vantage[me], cut[me] = best, t
        work += [(points[inside], me, False), (points[~inside], me, True)]
    return Tree(mask, radius, np.array(vantage, np.uint64), np.array(cut), np.array(near), np.array(far))


def route(tree: Tree, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, leaf, owner) of every shard a fingerprint lives in (owner) or visits.

    Only the near side visits the far side: of a pair that a node separates, the near one is sent after the far one.
    """
    index, node, owner = np.arange(len(fps)), np.zeros(len(fps), int), np.ones(len(fps), bool)
    out = []
    while len(index):
        leaf = tree.near[node] < 0
        out.append((index[leaf], node[leaf], owner[leaf]))
        index, node, owner = index[~leaf], node[~leaf], owner[~leaf]
        d = np.bitwise_count((fps[index] ^ tree.vantage[node]) & np.uint64(tree.mask)).astype(int)
        t = tree.cut[node]
        near = np.where(owner, d <= t, d - tree.radius <= t)
        far = np.where(owner, d > t, d + tree.radius > t)
        across = owner & near & (d + tree.radius > t)
        index, owner, node = (np.concatenate([index[near], index[far], index[across]]),
                              np.concatenate([owner[near], owner[far], np.zeros(across.sum(), bool)]),
                              np.concatenate([tree.near[node[near]], tree.far[node[far]], tree.far[node[across]]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (index, node, owner)


def local_links(owners: np.ndarray, others: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within the radius, one per fingerprint at most: (fingerprint, smallest connected)."""
    every, where = np.unique(np.concatenate([owners, others]), return_inverse=True)
    label = np.arange(len(every))
    mine, theirs = where[: len(owners)], where[len(owners):]
    for at in range(0, len(owners), block):
        i, j = np.nonzero(np.bitwise_count(owners[at:at + block, None] ^ others[None, :]) <= radius)
        a, b = mine[at:at + block][i], theirs[j]
        a, b = a[a != b], b[a != b]
        while len(a):
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low), np.minimum.at(label, lb, low)
            while (label[label] != label).any():
                label = label[label]
    moved = label != np.arange(len(every))
    return every[moved], every[label[moved]]


def link_fingerprints(fps: DataFrame, radius: int = 3, slices: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(u, v) links over the distinct bigints of the stored column ``fp``, enough to connect all pairs within ``radius``."""
    spark = fps.sparkSession
    total = fps.count()
    drawn = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    aimed = max(8, int(leaf * len(drawn) / max(total, 1)))
    width = 64 // slices
    masks = [((1 << (64 - width * k if k == slices - 1 else width)) - 1) << (width * k) for k in range(slices)]
    trees = spark.sparkContext.broadcast([grow_tree(drawn, m, radius // slices, aimed) for m in masks])

    def shards(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, tree in enumerate(trees.value):
                index, node, owner = route(tree, own)
                yield pa.RecordBatch.from_arrays([pa.array(own[index].view(np.int64)), pa.array(node.astype(np.int64) * slices + k),
                                                  pa.array(owner)], names=["fp", "shard", "owner"])

    placed = shared_table(fps.select("fp").mapInArrow(shards, "fp bigint, shard bigint, owner boolean"), "shards")
    sizes = placed.groupBy("shard").agg(F.sum(F.col("owner").cast("long")).alias("n"), F.count("*").alias("m")).select(
        "shard", F.ceil(F.col("n") / CELL).alias("rows"), F.ceil(F.col("m") / CELL).alias("cols")).where("m > 1 and n > 0")
    dealt = placed.join(F.broadcast(sizes), "shard")  # a row per leaf of trees with at most ``sample`` / 8 leaves each
    row, col = F.pmod(F.xxhash64("fp"), "rows"), F.pmod(F.xxhash64("fp"), "cols")
    as_row = dealt.where("owner").select("shard", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"),
                                         "fp", F.lit(True).alias("owner"))
    as_col = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), col.alias("j"), "fp",
                          F.lit(False).alias("owner"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        own, fp = cell["owner"].to_numpy(), cell["fp"].to_numpy(np.int64).view(np.uint64)
        u, v = local_links(fp[own], fp[~own], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return as_row.unionByName(as_col).groupBy("shard", "i", "j").applyInPandas(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3,
                    slices: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable through fingerprints within ``radius`` bits.

    Texts without words have fingerprint 0 and link like any other; repeated rows are returned as often as they come;
    a null doc_id takes part but never names a component unless the whole component has none; an empty table gives no
    rows; other columns are not read.
    """
    marked = shared_table(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words),
                          "fingerprints")
    firsts = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = shared_table(components(link_fingerprints(firsts, radius, slices)), "roots")
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
