"""Running values over long ordered groups without putting a group into one task.

A plain ``sum() over (partition by doc order by seq)`` sorts a whole document in one task. Here the order column is cut
into fixed blocks: windows run inside a (group, block), and only one row per block crosses blocks. The result is the
same; the work of a hot group spreads over its blocks, and the second window is smaller by the block length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = "__block"


def _with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.coalesce(F.col(order), F.lit(0)) / F.lit(width)))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                width: int = 65536, inclusive: bool = True) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows of the group up to this one (``order`` unique per group)."""
    keys = list(keys)
    blocked = _with_block(df.withColumn("__value", value), order, width)
    totals = blocked.groupBy(*keys, BLOCK).agg(F.sum("__value").alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(
        W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    inside = F.sum("__value").over(
        W.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    own = F.lit(0) if inclusive else F.col("__value")
    return (blocked.join(before, [*keys, BLOCK])
            .withColumn(name, F.col("__before") + inside - own)
            .drop("__value", "__before", BLOCK))


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], block_on: str, name: str,
                   width: int = 65536) -> DataFrame:
    """Add ``name`` = 0-based position of the row in its group; ``order`` starts with ``block_on``."""
    keys = list(keys)
    blocked = _with_block(df, block_on, width)
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__rows"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(
        W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__rows")
    inside = F.row_number().over(W.partitionBy(*keys, BLOCK).orderBy(*order))
    return (blocked.join(before, [*keys, BLOCK])
            .withColumn(name, (F.col("__before") + inside - 1).cast("int")).drop("__before", BLOCK))


def last_before(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: Column, name: str,
                width: int = 65536) -> DataFrame:
    """Add ``name`` = latest non-null ``value`` of the group at or before this row in (``order``, ``tie``)."""
    keys = list(keys)
    blocked = _with_block(df.withColumn("__value", value), order, width)
    ends = blocked.where(F.col("__value").isNotNull()).groupBy(*keys, BLOCK).agg(
        F.max_by("__value", F.struct(order, tie)).alias("__end"))
    spine = blocked.select(*keys, BLOCK).distinct().join(ends, [*keys, BLOCK], "left")
    carry = spine.withColumn("__carry", F.last("__end", ignorenulls=True).over(
        W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1))).drop("__end")
    inside = F.last("__value", ignorenulls=True).over(
        W.partitionBy(*keys, BLOCK).orderBy(order, tie).rowsBetween(W.unboundedPreceding, 0))
    return (blocked.join(carry, [*keys, BLOCK])
            .withColumn(name, F.coalesce(inside, F.col("__carry"))).drop("__value", "__carry", BLOCK))
