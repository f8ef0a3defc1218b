"""Store algebra: members of stores, live views, snapshots, splits, merges, set relations.

A member relation has one row per (store_id, file_id) with version_id and the file facts that filters need. Newest
versions are chosen by aggregation with map-side combine, so a file or store with very many rows never meets one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seamark.functions.metadata import contains, display, is_scalar
from seamark.functions.text import slug
from seamark.operators.embedding import missing_vectors
from seamark.schemas import STORE_FILTER
from seamark.session import cut_lineage

MAX_VIEW_DEPTH = 3  # fixed value
MAX_SPLITS = 50  # fixed value
TARGETS = T.ArrayType(T.StructType([T.StructField("store_id", T.StringType()), T.StructField("f", STORE_FILTER)]))
FACTS = ["path", "metadata", "media_type", "version_no", "sha256"]


def file_facts(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of live files with the columns filters look at."""
    alive = files.where(F.col("deleted_at").isNull()).select("file_id", "path", "metadata")
    return versions.select("file_id", "version_id", "version_no", "media_type", "sha256").join(alive, "file_id")


def members_direct(stores: DataFrame, store_files: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """Members of material stores and snapshots: the pinned version, else the current one; live files only."""
    holding = stores.where(F.col("deleted_at").isNull() & F.col("kind").isin("material", "snapshot")).select("store_id")
    alive = files.where(F.col("deleted_at").isNull()).select("file_id", "current_version_id", "path", "metadata")
    rows = (store_files.select("store_id", "file_id", "pinned_version_id").join(holding, "store_id", "left_semi")
            .join(alive, "file_id")
            .withColumn("version_id", F.coalesce("pinned_version_id", "current_version_id"))
            .where(F.col("version_id").isNotNull()).drop("pinned_version_id", "current_version_id"))
    facts = versions.select("version_id", "version_no", "media_type", "sha256")
    return rows.join(facts, "version_id", "left").select("store_id", "file_id", "version_id", *FACTS)


def _passes(f: Column) -> Column:
    """Condition of a view's filter on the columns of a member row."""
    kinds, prefix = f["media_types"], f["path_prefix"]
    return (contains(F.col("metadata"), f["metadata"]) & (prefix.isNull() | F.startswith(F.col("path"), prefix))
            & (kinds.isNull() | F.coalesce(F.array_contains(kinds, F.col("media_type")), F.lit(False))))


def _targets(views: DataFrame) -> DataFrame:
    """(store_id, targets): the views over each parent with their filters. As many entries as there are views."""
    each = views.select(F.explode(F.array_distinct("definition.parents")).alias("store_id"),
                        F.struct("store_id", F.col("definition.filter").alias("f")).alias("target"))
    return each.groupBy("store_id").agg(F.collect_list("target").alias("targets"))


def resolve_views(views: DataFrame, members: DataFrame, keep: bool = False) -> DataFrame:
    """Members of ``views`` from already resolved ``members`` of their parents: filter, then newest version per file.

    ``keep`` also returns the given members: a row is sent to its own store and to the views it passes, in one go, so
    the plan reads its input once however deep the views are.
    """
    shown = F.transform(F.filter(F.coalesce("targets", F.array().cast(TARGETS)), lambda v: _passes(v["f"])), lambda v: v["store_id"])
    stores = F.concat(F.array("store_id"), shown) if keep else shown
    sent = members.join(_targets(views), "store_id", "left" if keep else "inner")
    return newest_version(sent.withColumn("store_id", F.explode(stores)).drop("targets"))


def newest_version(rows: DataFrame) -> DataFrame:
    """One row per (store_id, file_id): the highest version_no (nulls last), then the smallest version id."""
    newest = F.min_by(F.struct("version_id", *FACTS), F.struct(
        F.coalesce(-F.col("version_no"), F.lit(2147483647)).alias("o"), F.col("version_id").alias("v")))
    return rows.groupBy("store_id", "file_id").agg(newest.alias("m")).select("store_id", "file_id", "m.*")


def resolve_all(stores: DataFrame, store_files: DataFrame, files: DataFrame, versions: DataFrame,
                checkpoint: bool = False) -> DataFrame:
    """Members of every live store. Views are resolved level by level (at most three), all views of a level at once.

    ``checkpoint`` stores the result, for jobs that use it several times.
    """
    resolved = members_direct(stores, store_files, files, versions)
    live_views = stores.where(F.col("deleted_at").isNull() & (F.col("kind") == "view"))
    for depth in range(1, MAX_VIEW_DEPTH + 1):
        resolved = resolve_views(live_views.where(F.col("definition.depth") == depth), resolved, keep=True)
    return cut_lineage(resolved) if checkpoint else resolved


def snapshot(members: DataFrame, store_id: str, snapshot_id: str) -> DataFrame:
    """Membership rows that freeze the present members of a store with their versions pinned."""
    return members.where(F.col("store_id") == store_id).select(
        F.lit(snapshot_id).alias("store_id"), "file_id", F.col("version_id").alias("pinned_version_id"))


def derivation_check(wanted: DataFrame, stores: DataFrame, revisions: DataFrame) -> DataFrame:
    """Check ``wanted(name, parents)``: depth of the new view and the first error, if any."""
    alive = stores.where(F.col("deleted_at").isNull())
    profile = alive.join(revisions.select(F.col("revision_id").alias("active_revision_id"), "profile_id"),
                         "active_revision_id", "left")
    own_depth = F.when(F.col("kind") == "view", F.coalesce(F.col("definition.depth"), F.lit(1))).otherwise(0)
    parents = profile.select("store_id", own_depth.alias("d"), "profile_id")
    asked = wanted.select("name", F.explode(F.array_distinct("parents")).alias("store_id"))
    taken = alive.select(F.lower("name").alias("lname")).distinct().withColumn("taken", F.lit(True))
    return (asked.join(parents, "store_id", "left").groupBy("name").agg(
        F.count_if(F.col("d").isNull()).alias("missing"), F.countDistinct("profile_id").alias("profiles"),
        (F.max("d") + 1).alias("depth")).withColumn("lname", F.lower("name")).join(taken, "lname", "left")
        .withColumn("error", F.when(F.col("missing") > 0, "RESOURCE_NOT_FOUND")
                    .when(F.col("profiles") > 1, "PROFILE_INCOMPATIBLE")
                    .when(F.col("depth") > MAX_VIEW_DEPTH, "INVALID_REQUEST")
                    .when(F.col("taken"), "CONFLICT"))
        .select("name", "profiles", "depth", "error"))


def split_by_field(members: DataFrame, stores: DataFrame, store_id: str, field: str, prefix: str,
                   max_splits: int = MAX_SPLITS) -> DataFrame:
    """One view per distinct scalar value of a metadata field: value, typed literal, name, outcome.

    More than ``max_splits`` values refuse the whole split: every row then carries that error.
    """
    own = members.where(F.col("store_id") == store_id)
    typed = F.try_element_at("metadata", F.lit(field))
    values = (own.select(typed.alias("literal")).where(is_scalar(F.col("literal")))
              .groupBy(display(F.col("literal")).alias("value")).agg(F.min("literal").alias("literal"),
                                                                     F.count(F.lit(1)).alias("files")))
    taken = stores.where(F.col("deleted_at").isNull()).select(F.lower("name").alias("lname")).distinct()
    named = values.withColumn("name", F.substring(F.concat(F.lit(prefix + "-"), slug(F.col("value"))), 1, 100))
    # two values may share a slug: the first by value gets the name
    first = named.groupBy("name").agg(F.min("value").alias("value"), F.lit(True).alias("first"))
    checked = (named.join(first, ["name", "value"], "left").withColumn("lname", F.lower("name"))
               .join(taken.withColumn("taken", F.lit(True)), "lname", "left"))
    total = values.agg(F.count(F.lit(1))).scalar()
    return checked.select("value", "literal", "name", "files", F.when(total > max_splits, "too many values")
                          .when(F.col("taken") | F.col("first").isNull(), "name exists")
                          .otherwise("created").alias("outcome"))


def merge_members(members: DataFrame, stores: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Members of several stores, first source in list order wins per file; ``pinned`` if that source is a snapshot."""
    rank = F.lit(None).cast("int")
    for position, store_id in enumerate(sources):
        rank = F.when(F.col("store_id") == store_id, position).otherwise(rank)
    kinds = stores.where(F.col("deleted_at").isNull() & F.col("store_id").isin(list(sources))).select(
        "store_id", (F.col("kind") == "snapshot").alias("pinned"))
    rows = members.where(F.col("store_id").isin(list(sources))).join(kinds, "store_id").withColumn("ord", rank)
    best = F.min_by(F.struct("version_id", "pinned", "path", "sha256"), "ord")
    return rows.groupBy("file_id").agg(best.alias("m")).select("file_id", "m.*")


def merge_stores(members: DataFrame, stores: DataFrame, segments: DataFrame, sources: Sequence[str], target: str,
                 profile_id: str) -> DataFrame:
    """Membership rows of the merged store: equal path and bytes count once, members without vectors stay out."""
    chosen = merge_members(members, stores, sources)
    unique = chosen.groupBy("path", "sha256").agg(F.min_by(F.struct("file_id", "version_id", "pinned"), "file_id")
                                                  .alias("m")).select("m.*")
    ready = segments.where(F.col("profile_id") == profile_id).select("version_id")
    return unique.join(ready, "version_id", "left_semi").select(
        F.lit(target).alias("store_id"), "file_id",
        F.when(F.col("pinned"), F.col("version_id")).alias("pinned_version_id"))


def merge_report(members: DataFrame, stores: DataFrame, segments: DataFrame, sources: Sequence[str],
                 profile_id: str) -> DataFrame:
    """One row: references in the sources, memberships written, duplicates removed."""
    alive = stores.where(F.col("deleted_at").isNull()).select("store_id")
    refs = members.where(F.col("store_id").isin(list(sources))).join(alive, "store_id", "left_semi").agg(
        F.count(F.lit(1)).alias("n")).scalar()
    chosen = merge_members(members, stores, sources)
    counts = chosen.groupBy("path", "sha256").agg(F.lit(1).alias("one"))
    written = merge_stores(members, stores, segments, sources, "t", profile_id)
    unique = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return written.agg(F.count(F.lit(1)).alias("memberships")).select(
        refs.alias("source_references"), "memberships", (refs - unique).alias("duplicates_removed"))


def merge_compatible(stores: DataFrame, revisions: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row: number of profiles among the sources and whether a merge without rebuilding is possible."""
    active = revisions.select(F.col("revision_id").alias("active_revision_id"), "profile_id")
    chosen = stores.where(F.col("store_id").isin(list(sources)) & F.col("deleted_at").isNull())
    return chosen.join(active, "active_revision_id").agg(F.countDistinct("profile_id").alias("profiles")).withColumn(
        "compatible", F.col("profiles") == 1)


def merge_rebuild(members: DataFrame, stores: DataFrame, segments: DataFrame, sources: Sequence[str],
                  profile_id: str) -> DataFrame:
    """Members that need vectors of the target profile before the merge can be published."""
    return missing_vectors(merge_members(members, stores, sources), segments, profile_id)


def remove_members(store_files: DataFrame, stores: DataFrame, removals: DataFrame) -> DataFrame:
    """Membership without ``removals(store_id, file_id)``; views hold no rows of their own and are left alone."""
    own = stores.where(F.col("kind") != "view").select("store_id")
    return store_files.join(removals.join(own, "store_id", "left_semi").select("store_id", "file_id"),
                            ["store_id", "file_id"], "left_anti")


def shared_sources(store_files: DataFrame, stores: DataFrame, store_id: str) -> DataFrame:
    """Sources of a store with ``shared``: some other live store holds them too."""
    alive = stores.where(F.col("deleted_at").isNull()).select("store_id")
    others = (store_files.where(F.col("store_id") != store_id).join(alive, "store_id", "left_semi")
              .select("file_id").distinct().withColumn("shared", F.lit(True)))
    own = store_files.where(F.col("store_id") == store_id).select("store_id", "file_id")
    return own.join(others, "file_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def dependents(stores: DataFrame, store_id: str) -> DataFrame:
    """Live views right over a store."""
    return stores.where(F.col("deleted_at").isNull() & (F.col("kind") == "view")
                        & F.array_contains("definition.parents", store_id)).select("store_id", "name")


def file_references(members: DataFrame, stores: DataFrame, file_id: str) -> DataFrame:
    """Stores, snapshots and views that show a file."""
    hits = members.where(F.col("file_id") == file_id).select("store_id")
    return stores.where(F.col("deleted_at").isNull()).join(hits, "store_id", "left_semi").select(
        "store_id", "name", "kind")
