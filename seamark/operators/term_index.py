"""The stored term index: postings in a table bucketed by term, added to version by version.

A posting belongs to the bucket of its term, so counting terms and joining on them moves no posting. Batches append files to
the buckets; segments of versions that are replaced or deleted are listed beside the table and masked when it is read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.operators.keyword import build_postings
from seamark.session import bounded, checkpoint_root, dealt

MAX_DEAD = 1_000_000  # masked segments that may be broadcast
BUCKET_BYTES = 32_000_000  # of text, whose postings may share a bucket
TASK_BYTES = 8_000_000     # of text, whose postings one task may sort and write: a batch adds as many files to a bucket as that takes


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str
    buckets: int

    @property
    def _name(self) -> str:
        return "term_postings_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    def add(self, segments: DataFrame, size: int | None = None) -> None:
        """Append the postings of passages (segment_id, content). A passage must be added once: ids name versions.

        The tasks that write grow with the text (``size`` bytes, counted if not given), also those of one bucket, so neither
        a large batch nor a term of every passage lands in one task.
        """
        size = text_bytes(segments) if size is None else size
        salts = max(1, -(-size // (self.buckets * TASK_BYTES)))
        bucket, salt = F.pmod(F.hash("term"), F.lit(self.buckets)), F.pmod(F.xxhash64("segment_id"), F.lit(salts)).cast("int")
        parted = (build_postings(dealt(segments, "content", size)).repartitionById(self.buckets * salts, bucket * salts + salt)
                  .select("segment_id", "positions", "term"))
        parted.sortWithinPartitions("term", "segment_id").write.insertInto(self._name)

    def mask(self, dead: DataFrame) -> None:
        """Passages of ``dead(segment_id)`` are no longer found."""
        dead.select("segment_id").distinct().write.mode("append").parquet(f"{self.path}/dead")

    def postings(self) -> DataFrame:
        """(segment_id, term, positions) of the passages that are not masked."""
        rows = self.spark.table(self._name).select("segment_id", "term", "positions")
        dead = self.spark.read.schema("segment_id string").parquet(f"{self.path}/dead")
        return rows if dead.isEmpty() else rows.join(bounded(dead, MAX_DEAD), "segment_id", "left_anti")


def text_bytes(segments: DataFrame) -> int:
    return segments.agg(F.sum(F.octet_length("content"))).first()[0] or 0


def buckets_for(size: int, least: int = 8) -> int:
    """Buckets of an index for ``size`` bytes of text: a join on terms reads a bucket in one task."""
    return max(least, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())


def open_term_index(spark: SparkSession, path: str | None = None, buckets: int = 64) -> TermIndex:
    """The index stored under ``path`` (a new one in the shared folder if none is named); ``buckets`` must be those it was
    made with."""
    index = TermIndex(spark, (path or f"{checkpoint_root(spark).rstrip('/')}/terms-{uuid.uuid4().hex}").rstrip("/"), buckets)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {index._name} (segment_id STRING, positions ARRAY<INT>, term STRING) USING parquet "
              f"CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{index.path}/postings'")
    spark.createDataFrame([], "segment_id string").write.mode("append").parquet(f"{index.path}/dead")
    return index
