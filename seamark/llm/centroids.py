"""Centroid clustering of integer vectors: exact k-means rounds over a vantage-point tree of the centroids.

Each round builds a vantage-point tree over the few centroids and sends it to the tasks. A task takes its vectors in
batches; every vector has its own queue of tree nodes, ordered by the least distance that the triangle inequality leaves
for what lies below them, and always opens its best node next. Vectors that open the same node in the same step are
computed together. A node is left closed only if its bound exceeds the best distance found, so an equal one is opened and
ties go to the smaller number. Distances and sums are integers throughout; square roots only order and prune, with a margin.

Only sums per cluster, and the centroids themselves, reach the driver: k x dims numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.llm.common import shared_table

LEAF = 2            # centroids that a leaf holds at most
MARGIN = 1e-6       # pruning bounds are loosened by this share and this amount, more than square roots can err by
MAX_VALUES = 4_000_000  # centroids x dims that may travel with the tasks (32 MB)
SCALE = 64


def whole_vectors(vectors: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of exactly ``dims`` components, none null or not finite."""
    x = F.col(embedding)
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(whole).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * component) of a matrix of doubles. Components whose squared distances could leave 64 bits are an error."""
    scaled = np.floor(x * scale)
    if scaled.size and np.abs(scaled).max() > (2 ** 62 / scaled.shape[-1]) ** 0.5 / 2:
        raise ValueError("a component is too large for exact distances")
    return scaled.astype(np.int64)


@dataclass
class Node:
    """A leaf with its centroids' numbers, or a centroid (vantage point) with an inner and an outer part."""

    members: np.ndarray               # of a leaf; of an inner node, the vantage point alone
    inside: int = -1                  # places of the parts in the list of nodes
    outside: int = -1
    near: tuple[float, float] = (0, 0)  # smallest and largest distance of the inner part from the vantage point
    far: tuple[float, float] = (0, 0)


def vantage_tree(centroids: np.ndarray) -> list[Node]:
    """Nodes, the root first. The vantage point is the centroid farthest from the first one of its part."""
    nodes: list[Node] = []

    def grow(numbers: np.ndarray) -> int:
        at = len(nodes)
        if len(numbers) <= LEAF:
            nodes.append(Node(numbers))
            return at
        first = squared(centroids[numbers], centroids[numbers[:1]])[:, 0]
        point = numbers[np.argmax(first)]
        rest = numbers[numbers != point]
        distance = np.sqrt(squared(centroids[rest], centroids[point:point + 1])[:, 0].astype(float))
        order = np.argsort(distance, kind="stable")
        rest, distance, half = rest[order], distance[order], (len(rest) + 1) // 2
        nodes.append(Node(np.array([point])))
        inside = grow(rest[:half])
        outside = grow(rest[half:])
        node = nodes[at]
        node.inside, node.outside = inside, outside
        node.near, node.far = (distance[0], distance[half - 1]), (distance[half], distance[-1])
        return at

    grow(np.arange(len(centroids)))
    return nodes


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two integer matrices."""
    return np.stack([np.einsum("ij,ij->i", a - row, a - row) for row in b], axis=1)


def assign(x: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row, the smaller number of equal ones, and how many
    distances were computed."""
    n = len(x)
    bounds = np.full((n, len(nodes)), np.inf)  # of the nodes in each vector's queue
    if n:
        bounds[:, 0] = 0
    best, number, computed = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), 0
    active = np.arange(n)
    while len(active):
        chosen = np.argmin(bounds[active], axis=1)
        reach = np.sqrt(best[active].astype(float)) * (1 + MARGIN) + MARGIN
        going = bounds[active, chosen] <= reach  # a queue that is empty has only infinite bounds
        active, chosen = active[going], chosen[going]
        bounds[active, chosen] = np.inf
        for k in np.unique(chosen):
            node, rows = nodes[k], active[chosen == k]
            distances = squared(x[rows], centroids[node.members])
            computed += distances.size
            for c, d in zip(node.members.tolist(), distances.T):
                better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], c
            if node.inside >= 0:
                d = np.sqrt(distances[:, 0].astype(float))
                for part, (low, high) in ((node.inside, node.near), (node.outside, node.far)):
                    bounds[rows, part] = np.maximum(0, np.maximum(low - d, d - high))
    return number, best, computed


def _matrix(column: pa.ListArray) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) per task: members and componentwise sums of each cluster."""
    shipped = vectors.sparkSession.sparkContext.broadcast((centroids, vantage_tree(centroids)))
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, nodes = shipped.value
        n, sums = np.zeros(len(table), np.int64), np.zeros(table.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                number = assign(x, table, nodes)[0]
                n += np.bincount(number, minlength=len(table))
                np.add.at(sums, number, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()),
                                          pa.array(sums[some].tolist(), schema.field(2).type)], schema=schema)

    return vectors.select("x").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    shipped = vectors.sparkSession.sparkContext.broadcast((centroids, vantage_tree(centroids)))
    name = vectors.schema["vec_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, nodes = shipped.value
        for batch in batches:
            number, distance, _ = assign(_matrix(batch.column(1)), table, nodes) if batch.num_rows else ([], [], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(label, f"vec_id {name}, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors whose id, as ``1:<vec_id>``, has the k smallest SHA-256 digests, in that order; of rows with one id
    those with the smaller vector first. Vectors without an id are no centroids at first."""
    keyed = vectors.where("vec_id is not null").select(
        F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "x")
    return integers(np.array([r["x"] for r in keyed.orderBy("h", "x").limit(k).collect()], float))


def refine(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every cluster's centroid becomes the floor of the mean of its vectors; an empty one stays."""
    parts = _sums(vectors, centroids).select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moved = centroids.copy()
    for r in totals.collect():  # k x dims rows
        moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return moved


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) stored, final centroids) of the vectors that ``whole_vectors`` keeps, as integers.

    ``vectors`` is read once per round and twice more, so it should be a stored table. Repeated rows count as often as
    they come; a null vec_id is assigned but starts no cluster; fewer than k vectors give fewer clusters, none give no rows;
    other columns are not read.
    """
    if k * dims > MAX_VALUES:
        raise ValueError("too many centroids to send to the tasks")
    kept = whole_vectors(vectors, dims, vec_id, embedding)
    centroids = first_centroids(kept, k)
    if not len(centroids):
        kept, centroids = kept.where("false"), np.zeros((1, dims), np.int64)
    for _ in range(rounds):
        centroids = refine(kept, centroids)
    return shared_table(_assigned(kept, centroids), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distances summed over its cluster and over all, and a digest of its centroid; the k rows that
    are joined are broadcast."""
    digests = F.create_map(*(F.lit(v) for i, c in enumerate(centroids) for v in (i, ",".join(map(str, c.tolist())))))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = sums.agg(F.sum("s").cast("bigint").alias("t")).scalar()
    per = sums.select("cluster", F.col("s").cast("bigint").alias("cluster_inertia"), F.sha2(digests[F.col("cluster")].cast("binary"), 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
