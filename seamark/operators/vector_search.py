"""Exact vector top-k for a table of queries, and the block kernel that approximate search shares.

No pair of query and segment ever becomes a row: each task multiplies matrices block by block and keeps only its best
k per query, so the shuffle carries tasks x queries x k rows. A small query table (checked) is shipped to the tasks and
the segments are scanned in place; a larger one is laid out with the segments on a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seamark.functions.vectors import DISTANCE_DIGITS, matrix, unit_rows
from seamark.operators.filters import Filter, matches
from seamark.session import bounded

SHIPPED_QUERIES, SHIPPED_VALUES = 4096, 4_000_000  # queries, and queries x dims, that may travel with the tasks (32 MB)
CELL_QUERIES, CELL_SEGMENTS = 2048, 16384  # largest cell of the grid
MAX_MEMBERS = 1_000_000  # versions of a store that may be broadcast
QUERY_BLOCK = 256  # rows of one matrix product
PRODUCT_SLACK = 1e-9  # more than a matrix product of unit rows and the distance of a pair can differ by


def pair_distances(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosine distance of the pairs (row, col), summed component by component, so it depends on the two vectors alone. A matrix
    product adds in an order that follows the shape of its block: copies of one vector may differ there in the last digit."""
    product, left, right = np.zeros(len(row)), np.zeros(len(queries)), np.zeros(len(vectors))
    for q, v in zip(queries.T, vectors.T):
        product += q[row] * v[col]
        left += q * q
        right += v * v
    lengths = np.sqrt(left[row] * right[col])
    distance = 1.0 - np.clip(product / np.where(lengths == 0, 1.0, lengths), -1.0, 1.0)
    return np.floor(distance * 10.0 ** DISTANCE_DIGITS + 0.5) / 10.0 ** DISTANCE_DIGITS


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
            groups: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows per query (and group) of one block, ties by id. A matrix product names the candidates, with some
    room for its rounding; their distances are then taken pair by pair."""
    parts = []
    labels = groups if groups is not None else np.zeros(len(ids), dtype=np.int8)
    for label in pd.unique(pd.Series(labels)):
        inside = np.flatnonzero(labels == label) if groups is not None else np.arange(len(ids))
        chosen = vectors[inside]
        near = unit_rows(chosen).T
        for at in range(0, len(query_ids), QUERY_BLOCK):
            asked = queries[at:at + QUERY_BLOCK]
            distance = 1.0 - unit_rows(asked) @ near
            if distance.shape[1] > k:  # keep all ties of the k-th distance, the id decides below
                bound = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
                row, col = np.nonzero(distance <= bound + PRODUCT_SLACK)
            else:
                row, col = np.nonzero(np.ones_like(distance, dtype=bool))
            parts.append(pd.DataFrame({"query_id": query_ids[at + row], "segment_id": ids[inside[col]],
                                       "distance": pair_distances(asked, chosen, row, col), "grp": label}))
    return keep_best(pd.concat(parts, ignore_index=True) if parts else None, k)


def keep_best(found: pd.DataFrame | None, k: int) -> pd.DataFrame | None:
    if found is None or found.empty:
        return found
    ordered = found.sort_values(["query_id", "grp", "distance", "segment_id"])
    return ordered.groupby(["query_id", "grp"], sort=False).head(k)


def _objects(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _result_batch(found: pd.DataFrame | None, schema: pa.Schema) -> pa.RecordBatch:
    columns = {"query_id": [], "segment_id": [], "distance": [], "grp": []} if found is None else found
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name].to_numpy() if found is not None else [], f.type) for f in schema], schema=schema)


def _types(queries: DataFrame, segments: DataFrame) -> tuple[str, pa.Schema]:
    fields = [("query_id", queries.schema["query_id"].dataType), ("segment_id", segments.schema["segment_id"].dataType)]
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in fields) + ", distance double, grp string"
    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields] + [("distance", pa.float64()), ("grp", pa.string())])
    return ddl, arrow


def _scan_topk(rows: list, queries: DataFrame, segments: DataFrame, k: int, group: str | None) -> DataFrame:
    """Queries travel with the tasks; every task keeps one running best list while it reads its segments."""
    ddl, arrow = _types(queries, segments)
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    grid = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    shipped = segments.sparkSession.sparkContext.broadcast((ids, grid))
    columns = ["segment_id", "embedding"] + ([group] if group else [])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows = shipped.value
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = best_of(query_rows, query_ids, matrix(batch.column("embedding"), unit=False),
                            _objects(batch.column("segment_id")), k,
                            _objects(batch.column(group)) if group else None)
            best = keep_best(found if best is None else pd.concat([best, found], ignore_index=True), k)
        if best is not None:
            if not group:
                best = best.assign(grp="")
            yield _result_batch(best, arrow)

    return segments.select(*columns).mapInArrow(kernel, ddl)


def grid_topk(queries: DataFrame, segments: DataFrame, k: int, cell: Sequence[str] = (),
              group: str | None = None) -> DataFrame:
    """Best k per query and grid cell for tables of any size.

    Both sides carry the ``cell`` columns (none: all in one cell). A cell is cut into segment chunks and query blocks of
    bounded size by hash, so a cell that holds a third of all rows becomes many tasks instead of one.
    """
    ddl, arrow = _types(queries, segments)
    cell = list(cell)
    columns = [*cell, "segment_id", "embedding"] + ([group] if group else [])

    def cuts(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    blocks, chunks = cuts(queries, CELL_QUERIES, "__blocks"), cuts(segments, CELL_SEGMENTS, "__chunks")
    if cell:
        sizes = blocks.join(chunks, cell)
        sized = lambda df: df.join(sizes, cell)
    else:  # one number each
        sized = lambda df: df.withColumn("__blocks", blocks.scalar()).withColumn("__chunks", chunks.scalar()).where(
            (F.col("__blocks") > 0) & (F.col("__chunks") > 0))
    left = (sized(queries.select(*cell, "query_id", "embedding"))
            .withColumn("__block", F.pmod(F.xxhash64("query_id"), F.col("__blocks")))
            .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
            .withColumn("__chunk", F.col("__chunk").cast("long")).drop("__blocks", "__chunks"))
    right = (sized(segments.select(*columns))
             .withColumn("__chunk", F.pmod(F.xxhash64("segment_id"), F.col("__chunks")))
             .withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
             .withColumn("__block", F.col("__block").cast("long")).drop("__blocks", "__chunks"))
    keys = [*cell, "__block", "__chunk"]

    def kernel(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        labels = _objects(stored.column(group)) if group else None
        found = best_of(matrix(asked.column("embedding"), unit=False), _objects(asked.column("query_id")),
                        matrix(stored.column("embedding"), unit=False), _objects(stored.column("segment_id")), k, labels)
        if not group:
            found = found.assign(grp="")
        return pa.Table.from_batches([_result_batch(found, arrow)])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, ddl)


def final_rank(candidates: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Rank the candidates of all tasks: distance, then id. The window drops rows beyond k before its shuffle."""
    keys = ["query_id"] + (["grp"] if group else [])
    order = W.partitionBy(*keys).orderBy("distance", "segment_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("grp", group) if group else ranked.drop("grp")


def search_exact(queries: DataFrame, segments: DataFrame, k: int, group: str | None = None,
                 max_shipped: int = SHIPPED_QUERIES) -> DataFrame:
    """Exact top-k: (query_id, segment_id, distance, rank), optionally per value of a segment column ``group``.

    ``queries(query_id, embedding)``, ``segments(segment_id, embedding, ...)``. The size of the query table is checked
    before it is shipped; larger tables take the grid.
    """
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    stored = segments.where(F.col("embedding").isNotNull())
    rows = asked.limit(max_shipped + 1).collect()
    if len(rows) <= max_shipped and sum(len(r["embedding"]) for r in rows) <= SHIPPED_VALUES:
        found = _scan_topk(rows, asked, stored, k, group)
    else:
        found = grid_topk(asked, stored, k, group=group)
    return final_rank(found, k, group)


def eligible(segments: DataFrame, members: DataFrame, profile_id: str, wanted: Filter | None = None,
             modalities: Sequence[str] | None = None) -> DataFrame:
    """Segments that may answer: of the profile, of members passing the filter, of the modalities. The filter comes
    before the ranking, so a selective filter still fills the result. A store of up to ``MAX_MEMBERS`` versions is broadcast,
    so the embeddings are scanned in place; a larger one is shuffled with them."""
    kept = members.where(matches(wanted)) if wanted else members
    rows = segments.where(F.col("profile_id") == profile_id)
    if modalities is not None:
        rows = rows.where(F.col("modality").isin(list(modalities)))
    return rows.join(bounded(kept.select("version_id").distinct(), MAX_MEMBERS), "version_id", "left_semi")
