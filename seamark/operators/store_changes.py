"""Memberships kept up to date: changes of stores carried through views, instead of resolving every store again.

A view's candidates are the rows its parents give it, with how many parents give each; its member per file is the newest of
them. A change adds to these counts or takes from them. Only the files it touches are decided again, and only decisions
that come out differently go on as changes to the next level of views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamark.operators.stores import FACTS, MAX_VIEW_DEPTH, TARGETS, _passes, _targets
from seamark.session import bounded, cut_lineage

MAX_TOUCHED = 1_000_000  # (store, file) pairs of a change that may be broadcast
KEY = ["store_id", "file_id", "version_id", "facts_id"]


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds a hash of the facts: a member whose path or metadata change is taken out and put in again."""
    pairs = F.to_json(F.array_sort(F.map_entries("metadata")))
    return rows.withColumn("facts_id", F.xxhash64("path", pairs, "media_type", "version_no", "sha256"))


def _summed(rows: DataFrame) -> DataFrame:
    """Rows with equal keys as one, their ``n`` added; rows that cancel out vanish."""
    facts = F.any_value(F.struct(*FACTS)).alias("f")
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), facts).where("n <> 0").select(*KEY, "f.*", "n")


def _newest(rows: DataFrame) -> DataFrame:
    """The member of each (store, file): the newest version, then the smallest id, then one place of its facts."""
    order = F.struct(F.coalesce(-F.col("version_no"), F.lit(2147483647)).alias("o"), F.col("version_id").alias("v"), F.col("facts_id").alias("i"))
    best = F.min_by(F.struct("version_id", "facts_id", *FACTS), order).alias("m")
    return rows.groupBy("store_id", "file_id").agg(best).select("store_id", "file_id", "m.*")


def _shown(rows: DataFrame, views: DataFrame) -> DataFrame:
    """Rows of ``views`` from rows of their parents."""
    passed = F.transform(F.filter(F.coalesce("targets", F.array().cast(TARGETS)), lambda v: _passes(v["f"])), lambda v: v["store_id"])
    return rows.join(_targets(views), "store_id").withColumn("store_id", F.explode(passed)).drop("targets")


def candidates_of(views: DataFrame, members: DataFrame) -> DataFrame:
    """(store_id, file_id, version_id, facts_id, facts, n): what the parents of each view give it, to be kept beside the members."""
    return _summed(with_identity(_shown(members, views)).withColumn("n", F.lit(1)))


def member_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two states of some stores: rows with ``n`` 1 (came) or -1 (went). Jobs that know what they change
    make such rows themselves."""
    return _summed(with_identity(after).withColumn("n", F.lit(1)).unionByName(with_identity(before).withColumn("n", F.lit(-1))))


def propagate(changes: DataFrame, candidates: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes of all members, changes of the candidates) that follow from ``changes`` of material stores and snapshots.

    ``views`` are the live views with their definitions. Per level the candidates of the touched files alone are looked up:
    their (store, file) pairs are broadcast if they are few (counted), so the table is scanned in place. Each level is stored.
    """
    every, given = cut_lineage(changes.select(*KEY, *FACTS, "n")), None
    for depth in range(1, MAX_VIEW_DEPTH + 1):
        level = views.where(F.col("definition.depth") == depth)
        incoming = cut_lineage(_summed(_shown(every, level)))
        touched = bounded(incoming.select("store_id", "file_id").distinct(), MAX_TOUCHED)
        old = cut_lineage(candidates.join(touched, ["store_id", "file_id"], "left_semi").select(*KEY, *FACTS, "n"))
        new = _summed(old.unionByName(incoming)).where("n > 0")
        turned = _newest(new).withColumn("n", F.lit(1).cast("bigint")).unionByName(_newest(old).withColumn("n", F.lit(-1).cast("bigint")))
        every = cut_lineage(every.unionByName(_summed(turned.select(*KEY, *FACTS, "n"))))
        given = incoming if given is None else given.unionByName(incoming)
    return every, given


def applied(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Members or candidates after ``changes``, with their count ``n``."""
    counted = rows if "n" in rows.columns else with_identity(rows).withColumn("n", F.lit(1).cast("bigint"))
    return _summed(counted.select(*KEY, *FACTS, "n").unionByName(changes.select(*KEY, *FACTS, "n")))
