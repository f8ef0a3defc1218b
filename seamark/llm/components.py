"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamark.llm.common import delete_table, shared_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) bigint links -> (node, root): root is the smallest node of the component; nodes without a link are absent.

    Each step is a grouped minimum with map-side combine and an equi-join that may be split where a hub is hot. The
    state is written to the shared folder after each round; only its count and checksum reach the driver.
    """
    edges = shared_table(_narrow(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))),
                         "components")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, both.where("v > u"))
        before, edges = edges, shared_table(_narrow(_hook(large, large, keep_node=True)), "components")
        delete_table(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _hook(edges: DataFrame, moved: DataFrame, keep_node: bool = False) -> DataFrame:
    """Link every neighbour in ``moved`` (and the node itself) to the smallest of the node and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hooked = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_node:
        hooked = hooked.unionByName(least.select("u", F.col("m").alias("v")))
    return hooked.where("u <> v")


def _narrow(edges: DataFrame) -> DataFrame:
    return edges.distinct()
