"""Sharding by a keyed permutation of row numbers: a Feistel network with cycle walking over 0 .. rows - 1.

The permuted number of a row decides its place: shard = number mod shards, slot = number div shards. So shard sizes in
rows differ by one at most, slots have no gaps, the shuffle is given by the seed, and the place of row number n (and the
row at a place, by the inverse) can be computed without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from seamark.llm.common import shared_table

ROUNDS = 6
M32 = np.uint64(0xFFFFFFFF)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    """The 32-bit finaliser of MurmurHash3, keyed by addition."""
    x = (x + np.uint64(key)) & M32
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & M32
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & M32
    return x ^ (x >> np.uint64(16))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B1 + (k + 1) * 0x7F4A7C15) & 0xFFFFFFFF for k in range(ROUNDS)]


def _network(x: np.ndarray, half: int, keys: list[int], inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (_round(left, key) & mask), left
        else:
            left, right = right, left ^ (_round(right, key) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, rows: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A bijection of 0 .. rows - 1. The network permutes at most four times as many; who lands outside walks on."""
    half = max(1, (max(rows - 1, 1).bit_length() + 1) // 2)
    keys, out = _keys(seed), np.asarray(numbers, np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        out = out.copy()
        out[todo] = _network(out[todo], half, keys, inverse)
        todo &= out >= np.uint64(rows)
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``row_number`` 0, 1, ... in ascending ``order``; rows equal in it are numbered in any order.

    Ranges of the order are sorted in parallel and written; one row per range is summed up to give each its offset.
    """
    spark = rows.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    stored = shared_table(ranged, "numbered").withColumn("__range", F.shiftright("__id", 33))
    offsets = stored.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(
        F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    return stored.join(F.broadcast(offsets), "__range").withColumn(
        "row_number", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__range", "__id", "__n", "__before")


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` (0 .. shards - 1) and ``slot`` (0, 1, ... in the shard).

    Nulls sort first; repeated rows get places of their own; an empty table gives no rows.
    """
    numbered = number_rows(rows, order)
    total = numbered.count()

    @F.pandas_udf(LongType())
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    placed = numbered.withColumn("__place", permuted("row_number"))
    return placed.withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn(
        "slot", F.floor(F.col("__place") / shards).cast("bigint")).drop("__place")
