"""Keyset pages: stable cursors instead of offsets, so page n costs the same as page 1."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, functions as F

MAX_PAGE = 200  # fixed value
SEGMENT_PAGE, MAX_SEGMENT_PAGE = 100, 500  # fixed values


def encode_cursor(created_at: str, row_id: str) -> str:
    """URL-safe cursor of the last row of a page; the time keeps its microseconds as text."""
    return base64.urlsafe_b64encode(json.dumps([created_at, row_id]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    created_at, row_id = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return created_at, row_id


def page(df: DataFrame, limit: int = 50, after: tuple[str, str] | None = None, row_id: str = "id",
         where: Column | None = None) -> DataFrame:
    """Newest rows first by (created_at, id), after a cursor; one row more than the page tells whether there is more."""
    rows = df if where is None else df.where(where)
    if after:
        at = F.lit(after[0]).cast(df.schema["created_at"].dataType)
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col(row_id) < F.lit(after[1]))))
    size = min(max(limit, 1), MAX_PAGE)
    return rows.orderBy(F.col("created_at").desc(), F.col(row_id).desc()).limit(size + 1)


def next_cursor(rows: list, limit: int, row_id: str = "id") -> str | None:
    """Cursor of a collected page, null on the last one."""
    if len(rows) <= limit:
        return None
    last = rows[limit - 1]
    return encode_cursor(str(last["created_at"]), str(last[row_id]))


def segments_page(segments: DataFrame, version_id: str, from_ordinal: int = 0, limit: int = SEGMENT_PAGE) -> DataFrame:
    """Segments of one version from an ordinal on; one row more than the page tells whether there is more."""
    if not 1 <= limit <= MAX_SEGMENT_PAGE:
        raise ValueError(f"limit accepts 1 to {MAX_SEGMENT_PAGE}")
    rows = segments.where((F.col("version_id") == version_id) & (F.col("ordinal") >= from_ordinal))
    return rows.orderBy("profile_id", "ordinal").limit(limit + 1)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key, by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = F.max(F.struct(*ordered)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def audit_page(events: DataFrame, limit: int = 50, before: int | None = None) -> DataFrame:
    """Audit events by falling id."""
    rows = events if before is None else events.where(F.col("id") < before)
    return rows.orderBy(F.col("id").desc()).limit(min(limit, MAX_PAGE) + 1)
