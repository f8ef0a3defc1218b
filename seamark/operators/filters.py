"""Row filters: metadata, path, media type, tenant, caller scope, liveness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from seamark.functions.metadata import contains
from seamark.sources.catalog import scoped

__all__ = ["Filter", "in_list", "live", "matches", "path_prefix", "restrict", "scoped"]


@dataclass(frozen=True)
class Filter:
    """What a search or a view keeps. Empty parts keep everything."""

    metadata: dict = field(default_factory=dict)
    path_prefix: str | None = None
    media_types: Sequence[str] | None = None


def path_prefix(path: Column, prefix: str | None) -> Column:
    return F.lit(True) if prefix is None else path.startswith(prefix)


def in_list(value: Column, allowed: Sequence[str] | None) -> Column:
    return F.lit(True) if allowed is None else value.isin(list(allowed))


def matches(f: Filter) -> Column:
    """Condition on columns metadata, path, media_type."""
    return (contains(F.col("metadata"), f.metadata) & path_prefix(F.col("path"), f.path_prefix)
            & in_list(F.col("media_type"), f.media_types))


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def restrict(df: DataFrame, members: DataFrame, store_ids: Sequence[str], key: str = "version_id") -> DataFrame:
    """Rows a caller limited to some stores may see: one of those stores must expose the version."""
    exposed = members.where(F.col("store_id").isin(list(store_ids))).select(key)
    return df.join(exposed, key, "left_semi")
