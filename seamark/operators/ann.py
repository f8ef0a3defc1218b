"""Vector search over lists of near vectors, with bounds that certify the answer.

The index splits the vectors into lists, over and over, until each list is below a size that follows the table. One
aggregation a level splits all open lists at once: a list's vectors on either side of a plane through about its middle give
two means, and the list is cut across the line between them at its own mean. Nothing is sampled. Every list has a centroid
and a radius, the largest distance of a vector from it, so no vector of a list is nearer to a question than the centroid's
distance less the radius.

A question probes lists in the order of this bound. Where a filter applies, the members it leaves are counted by list
first: lists without any are passed over, and lists are taken until they hold k members. The k-th hit then tells which
lists can still hold a nearer vector; they are probed in the same order up to a limit. A question whose k-th hit is nearer
than the bound of every list left over is certified: its answer is the exact one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.functions.vectors import matrix, unit_rows
from seamark.operators.vector_search import SHIPPED_QUERIES, SHIPPED_VALUES, _objects, _result_batch, _types, best_of, final_rank, keep_best
from seamark.session import checkpoint_root, cut_lineage

MAX_LIST_VALUES = 4_000_000  # lists x dims whose centroids and cutting planes may travel with the tasks (32 MB each)
MIN_LIST = 64                 # vectors below which a list is not split
MAX_LEVELS = 64
FOLDERS = 256                 # of a stored index; a search opens those of the lists it probes
HELD_HITS = 200_000           # hits of several lists that a task holds before it keeps the best
SLACK = 2e-9                  # distances are rounded at 12 digits, bounds at 9, and then give way by this much


@dataclass
class Tree:
    """Cutting planes: a vector goes to ``low`` if its product with the plane is below the cut, else to ``high``."""

    planes: np.ndarray                      # one row per node, zero for a list
    cuts: np.ndarray
    low: np.ndarray                         # -1: the node is a list
    high: np.ndarray

    @staticmethod
    def root(dims: int) -> Tree:
        return Tree(np.zeros((1, dims)), np.zeros(1), np.array([-1]), np.array([-1]))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        at = np.zeros(len(x), np.int64)
        going = np.arange(len(x)) if self.low[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            node = at[going]
            below = np.einsum("ij,ij->i", x[going], self.planes[node]) < self.cuts[node]
            at[going] = np.where(below, self.low[node], self.high[node])
            going = going[self.low[at[going]] >= 0]
        return at

    def split(self, nodes: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> Tree:
        """Each of ``nodes`` gets two lists below it, at the end: those of the first node come first."""
        children = len(self.cuts) + np.arange(2 * len(nodes))
        new = Tree(np.concatenate([self.planes, np.zeros((len(children), self.planes.shape[1]))]),
                   np.concatenate([self.cuts, np.zeros(len(children))]),
                   np.concatenate([self.low, np.full(len(children), -1)]), np.concatenate([self.high, np.full(len(children), -1)]))
        new.planes[nodes], new.cuts[nodes], new.low[nodes], new.high[nodes] = planes, cuts, children[::2], children[1::2]
        return new


@dataclass
class ListIndex:
    """Centroids, radii and sizes of the lists (bounded) and the stored vectors with their list."""

    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    rows: DataFrame               # folder, list, segment_id, embedding and the columns kept for filters
    levels: int = 0
    folders: int = 1


def list_size(total: int, dims: int) -> int:
    """Vectors a list should hold at most: the square root of the table, more where so many lists could not be shipped."""
    return max(MIN_LIST, int(2 * total ** 0.5), -(-2 * total * dims // MAX_LIST_VALUES))


def _halves(vectors: DataFrame, tree: Tree, middles: np.ndarray, normals: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum of vectors) by list and side of the plane through ``middles`` with ``normals``, and the lists' squared
    lengths: one pass and one aggregation for all lists."""
    shipped = vectors.sparkSession.sparkContext.broadcast((tree, middles, normals))
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, middles, normals = shipped.value
        n, sums = np.zeros(2 * len(tree.cuts), np.int64), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            node = tree.descend(x)
            side = 2 * node + (np.einsum("ij,ij->i", x - middles[node], normals[node]) >= 0)
            order = np.argsort(side, kind="stable")
            found, starts = np.unique(side[order], return_index=True)
            for k, s in zip(found.tolist(), np.add.reduceat(x[order], starts, axis=0)):
                sums[k] = sums[k] + s if k in sums else s
            n += np.bincount(side, minlength=len(n))
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n[keys] if keys else [], pa.int64()),
                                          pa.array([s.tolist() for s in sums.values()], schema.field(2).type)], schema=schema)

    parts = vectors.select("embedding").mapInArrow(add, "node bigint, n bigint, sums array<double>")
    totals = parts.select("node", "n", F.posexplode("sums").alias("i", "s")).groupBy("node", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = totals.toPandas()  # two sums per list and dimension
    node, i = found["node"].to_numpy(), found["i"].to_numpy()
    count, sums = np.zeros((len(tree.cuts), 2), np.int64), np.zeros((len(tree.cuts), 2, dims))
    count[node // 2, node % 2], sums[node // 2, node % 2, i] = found["n"], found["s"]
    return count, sums, count.sum(1)


def _grow(vectors: DataFrame, dims: int, size: int) -> tuple[Tree, int]:
    """Split every list above ``size`` whose vectors differ, level by level."""
    tree, middles, levels = Tree.root(dims), np.zeros((1, dims)), 0
    closed: set[int] = set()  # lists of equal vectors
    while True:
        normals = np.random.default_rng(levels).normal(size=(len(tree.cuts), dims))
        count, sums, n = _halves(vectors, tree, middles, normals, dims)
        leaves = [k for k in np.flatnonzero(tree.low < 0).tolist() if n[k] > size and k not in closed]
        mean = sums.sum(1) / np.maximum(n, 1)[:, None]
        spread = 1 - np.einsum("ij,ij->i", mean, mean)  # of unit vectors, by their mean
        closed |= {k for k in leaves if spread[k] < 1e-9}
        open_lists = [k for k in leaves if k not in closed]
        levels += 1
        if not open_lists or levels > MAX_LEVELS:
            return tree, levels
        able = np.array([k for k in open_lists if count[k].min() > 0], np.int64)
        half = sums[able] / np.maximum(count[able], 1)[:, :, None]
        planes = half[:, 1] - half[:, 0]
        cuts = np.einsum("ij,ij->i", planes, mean[able])
        grown = tree.split(able, planes, cuts)
        # a list whose vectors all fell on one side is tried again with another plane, now through its mean
        middles = np.concatenate([mean, half.reshape(-1, dims)])
        tree = grown


def build_index(segments: DataFrame, keep: tuple[str, ...] = (), size: int | None = None, path: str | None = None) -> ListIndex:
    """Lists over all segments with an embedding, stored under ``path`` (or in the shared folder).

    ``segments(segment_id, embedding, ...)`` is read once per level and should be a stored table; ``keep`` names columns
    that filters will need. Lists hold at most ``size`` vectors (``list_size`` if not given), but for equal vectors, which
    stay together. All vectors must have one length.
    """
    spark = segments.sparkSession
    kept = segments.where(F.col("embedding").isNotNull()).select("segment_id", "embedding", *keep)
    first = kept.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    total, dims = first["n"], first["dims"] or 1
    tree, levels = _grow(kept, dims, size or list_size(total, dims)) if total else (Tree.root(dims), 0)
    numbers = np.full(len(tree.cuts), -1)
    leaves = np.flatnonzero(tree.low < 0)
    numbers[leaves] = np.arange(len(leaves))
    folders = min(FOLDERS, -(-len(leaves) // 16))
    place = path or f"{checkpoint_root(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    listed = _with_list(kept, tree, numbers).withColumn("folder", (F.col("list") % folders).cast("int"))
    # a folder's lists are dealt to several tasks, so one list that holds a third of all vectors is no single file
    spread = listed.repartition("folder", F.pmod(F.xxhash64("segment_id"), F.lit(8))).sortWithinPartitions("folder", "list", "segment_id")
    spread.write.partitionBy("folder").parquet(f"{place}/rows")
    rows = spark.read.schema(listed.schema).parquet(f"{place}/rows")
    index = ListIndex(*_measure(rows, len(leaves), dims), rows, levels, folders)
    described = [(i, c.tolist(), float(r), int(n)) for i, (c, r, n) in enumerate(zip(index.centroids, index.radii, index.sizes))]
    spark.createDataFrame(described, "list int, centroid array<double>, radius double, size bigint").coalesce(1).write.parquet(f"{place}/lists")
    return index


def load_index(spark: SparkSession, path: str) -> ListIndex:
    """An index written by :func:`build_index`."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # bounded by MAX_LIST_VALUES
    rows = spark.read.parquet(f"{path}/rows")
    folders = min(FOLDERS, -(-len(lists) // 16))
    return ListIndex(np.array([r["centroid"] for r in lists]), np.array([r["radius"] for r in lists]), np.array([r["size"] for r in lists]),
                     rows, 0, folders)


def _with_list(vectors: DataFrame, tree: Tree, numbers: np.ndarray) -> DataFrame:
    shipped = vectors.sparkSession.sparkContext.broadcast((tree, numbers))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", list int"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = shipped.value
        for batch in batches:
            found = numbers[tree.descend(matrix(batch.column("embedding")))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "list"])

    return vectors.mapInArrow(kernel, ddl)


def _measure(rows: DataFrame, lists: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (means), radii and sizes of the stored lists."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(lists, np.int64), np.zeros((lists, dims))
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0).to_numpy()
                n += np.bincount(number, minlength=lists)
                np.add.at(sums, number, matrix(batch.column(1)))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.float64()))],
                                         names=["list", "n", "sums"])

    sizes, centroids = np.zeros(lists, np.int64), np.zeros((lists, dims))
    parts = rows.select("list", "embedding").mapInArrow(add, "list int, n bigint, sums array<double>").select("list", "n", F.posexplode("sums").alias("i", "s"))
    found = parts.groupBy("list", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()  # lists x dims
    number = found["list"].to_numpy()
    sizes[number], centroids[number, found["i"].to_numpy()] = found["n"], found["s"] / found["n"]
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, most = shipped.value, np.zeros(lists)
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0).to_numpy()
                np.maximum.at(most, number, np.linalg.norm(matrix(batch.column(1)) - table[number], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists, dtype=np.int32)), pa.array(most)], names=["list", "most"])

    radii = np.zeros(lists)
    for r in rows.select("list", "embedding").mapInArrow(reach, "list int, most double").groupBy("list").agg(F.max("most").alias("m")).collect():
        radii[r["list"]] = r["m"]
    return centroids, radii, sizes


def _scan(rows: DataFrame, index: ListIndex, ids: np.ndarray, grid: np.ndarray, probes: list[np.ndarray], k: int, queries: DataFrame) -> DataFrame:
    """Best k per question and task of the lists it probes. Questions travel with the tasks, vectors stay where they are."""
    ddl, arrow = _types(queries, index.rows)
    asking: dict[int, list[int]] = {}
    for q, lists in enumerate(probes):
        for number in lists.tolist():
            asking.setdefault(number, []).append(q)
    shipped = rows.sparkSession.sparkContext.broadcast((ids, grid, {number: np.array(qs) for number, qs in asking.items()}))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, asking = shipped.value
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, parts, held = batch.column("list").to_numpy(), [best], 0
            vectors, segment_ids = matrix(batch.column("embedding"), unit=False), _objects(batch.column("segment_id"))
            for value in np.unique(number).tolist():
                qs = asking.get(value)
                if qs is not None:
                    inside = np.flatnonzero(number == value)
                    parts.append(best_of(query_rows[qs], query_ids[qs], vectors[inside], segment_ids[inside], k))
                    held += len(parts[-1])
                    if held > HELD_HITS:
                        parts, held = [keep_best(pd.concat([p for p in parts if p is not None], ignore_index=True), k)], 0
            parts = [p for p in parts if p is not None]
            best = keep_best(pd.concat(parts, ignore_index=True), k) if parts else None
        if best is not None:
            yield _result_batch(best.assign(grp=""), arrow)

    wanted = sorted({number % index.folders for number in asking})
    read = rows.where(F.col("folder").isin(wanted)) if len(wanted) < index.folders else rows
    return read.select("list", "segment_id", "embedding").mapInArrow(kernel, ddl)


def search_lists(queries: DataFrame, index: ListIndex, k: int, probes: int = 8, limit: int | None = None,
                 within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Top-k of ``queries(query_id, embedding)``: (query_id, segment_id, distance, rank, certified).

    The first ``probes`` lists of each question, more until they hold k vectors, then those that can still improve it, up
    to ``limit`` lists in all (none: as many as it takes, and every answer is exact and certified). ``within`` filters rows of
    the index, on the columns kept for it, before anything is counted or ranked. Questions without a vector are left out;
    a question table of any size is answered in blocks that travel with the tasks in turn.
    """
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    if not size["n"]:
        return _no_hits(queries, index)
    per_block = max(1, min(SHIPPED_QUERIES, SHIPPED_VALUES // size["dims"]))
    blocks = -(-2 * size["n"] // per_block) if size["n"] > per_block else 1  # about half full, so that none is too large
    rows = index.rows if within is None else within(index.rows)
    members = index.sizes
    if within is not None:
        members = np.zeros_like(index.sizes)
        for r in rows.groupBy("list").count().collect():  # one row per list
            members[r["list"]] = r["count"]
    results = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = _answer(part.collect(), queries, index, rows, members, k, probes, limit)
        results = found if results is None else results.unionByName(found)
    return results


def _no_hits(queries: DataFrame, index: ListIndex) -> DataFrame:
    ddl, _ = _types(queries, index.rows)
    return queries.sparkSession.createDataFrame([], ddl).select("query_id", "segment_id", "distance", F.lit(0).alias("rank"), F.lit(True).alias("certified"))


def _answer(block: list, queries: DataFrame, index: ListIndex, rows: DataFrame, members: np.ndarray, k: int, probes: int,
            limit: int | None) -> DataFrame:
    if not block:
        return _no_hits(queries, index)
    ids = np.array([r["query_id"] for r in block], dtype=object)
    grid = np.array([r["embedding"] for r in block], dtype=np.float64)
    able = np.flatnonzero(members)
    if not len(able):
        return _no_hits(queries, index)
    # a vector within cosine distance d of a unit vector lies within sqrt(2 d) of it
    apart = np.sqrt(np.maximum(0, 1 + (index.centroids[able] ** 2).sum(1) - 2 * unit_rows(grid) @ index.centroids[able].T))
    bounds = np.round(np.maximum(0, apart - index.radii[able]) ** 2 / 2, 9) - SLACK
    order = np.lexsort((apart, bounds))  # where balls overlap, the nearer centroid first
    bounds = np.take_along_axis(bounds, order, 1)
    held = np.cumsum(members[able][order], axis=1)
    first = np.maximum(min(probes, len(able)), (held < k).sum(1) + 1)
    first = np.minimum(first, len(able))
    lists = lambda upto, since=None: [able[order[q, (0 if since is None else since[q]):upto[q]]] for q in range(len(ids))]
    found = cut_lineage(final_rank(_scan(rows, index, ids, grid, lists(first), k, queries), k))
    reached = _kth(found, ids, k)
    # lists in the order of their bounds, as far as one can still hold a vector at the k-th distance or nearer
    needed = np.array([np.searchsorted(bounds[q], reached[q], side="right") for q in range(len(ids))])
    until = np.maximum(first, needed if limit is None else np.minimum(needed, limit))
    if (until > first).any():
        more = _scan(rows, index, ids, grid, lists(until, first), k, queries)
        found = cut_lineage(final_rank(found.withColumn("grp", F.lit("")).drop("rank").unionByName(more), k))
        reached = _kth(found, ids, k)
    sure = [bool(until[q] == len(able) or bounds[q, until[q]] > reached[q]) for q in range(len(ids))]
    flags = queries.sparkSession.createDataFrame([(q, s) for q, s in zip(ids.tolist(), sure)],
                                                 f"query_id {queries.schema['query_id'].dataType.simpleString()}, certified boolean")
    return found.join(F.broadcast(flags), "query_id").select("query_id", "segment_id", "distance", "rank", "certified")


def _kth(found: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The distance of each question's k-th hit, infinite if it has fewer. One row per question."""
    last = {r["query_id"]: r["d"] for r in found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("d")).collect()}
    return np.array([last.get(q, np.inf) for q in ids])
