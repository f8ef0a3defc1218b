"""Catalogue of corpus tables: Parquet batches with a pointer that flips atomically, always read per tenant."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seamark.schemas import TABLES


class Catalog:
    """``<table>/data/batch=<id>/`` holds rows; ``<table>/_pointers/<n>`` lists the batches in force.

    A write goes to a fresh batch folder and becomes visible when the next pointer file is created (only if absent), so
    a reader sees the old or the new table, never a mixture, and of two writers one fails. Appending adds a batch to the
    list; the rows already there are not touched.
    """

    PARTITIONS = {"segments": ["workspace_id", "profile_id"]}
    # tables whose rows change: a later batch overrides a row by key, so a change costs its own rows only
    LATEST = {"files": (["workspace_id", "file_id"], "updated_at"),
              "deliveries": (["workspace_id", "store_id", "path"], "modified_at"),
              "job_items": (["workspace_id", "item_id"], "updated_at")}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, table: str, number: int):
        return self._path(f"{self.root}/{table}/_pointers/{number:012d}")

    def state(self, table: str) -> tuple[int, list[str]]:
        """(pointer number, batches) in force; (0, []) if the table was never written."""
        folder = self._path(f"{self.root}/{table}/_pointers")
        if not self._fs.exists(folder):
            return 0, []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        latest = max((int(n) for n in names if n.isdigit()), default=0)
        if not latest:
            return 0, []
        stream = self._fs.open(self._pointer(table, latest))
        try:
            return latest, json.loads(bytes(stream.readAllBytes()).decode("utf-8"))["batches"]
        finally:
            stream.close()

    def _rows(self, table: str) -> DataFrame:
        _, batches = self.state(table)
        if not batches:
            return self.spark.createDataFrame([], TABLES[table])
        base = f"{self.root}/{table}/data"
        schema = T.StructType([*TABLES[table].fields, T.StructField("batch", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/batch={b}" for b in batches])
        rows = rows.drop("batch")
        if table in self.LATEST and len(batches) > 1:  # one batch holds each key once
            keys, order = self.LATEST[table]
            rest = [c for c in rows.columns if c not in keys]
            newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
            rows = newest.select(*keys, "r.*").select(*TABLES[table].names)
        return rows

    def read(self, table: str, workspace_id: str | None) -> DataFrame:
        """Rows of one workspace; without a workspace there are none (fail closed)."""
        return scoped(self._rows(table), workspace_id)

    def read_all(self, table: str) -> DataFrame:
        """Rows of every workspace, for maintenance jobs."""
        return self._rows(table)

    def stage(self, table: str, rows: DataFrame) -> str:
        """Write rows to a batch no reader looks at yet."""
        batch = uuid.uuid4().hex
        schema = TABLES[table]
        present = set(rows.columns)
        shaped = rows.select(*[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in schema.fields])
        keys = self.PARTITIONS.get(table, ["workspace_id"])
        shaped.write.mode("errorifexists").partitionBy(*keys).parquet(f"{self.root}/{table}/data/batch={batch}")
        return batch

    def flip(self, table: str, batches: list[str], expected: int) -> int:
        """Put a list of batches in force, if nobody published since pointer number ``expected``."""
        stream = self._fs.create(self._pointer(table, expected + 1), False)  # fails if the number is taken
        try:
            stream.write(bytearray(json.dumps({"batches": batches}).encode("utf-8")))
        finally:
            stream.close()
        return expected + 1

    def publish(self, table: str, rows: DataFrame) -> int:
        """Replace the table by ``rows`` (which may be read from it)."""
        number, _ = self.state(table)
        return self.flip(table, [self.stage(table, rows)], number)

    def compact(self, table: str) -> int:
        """Rewrite the batches in force as one."""
        return self.publish(table, self._rows(table))

    def append(self, table: str, rows: DataFrame) -> int:
        """Add rows to the table."""
        number, batches = self.state(table)
        return self.flip(table, [*batches, self.stage(table, rows)], number)


def scoped(rows: DataFrame, workspace_id: str | None) -> DataFrame:
    """Rows of one tenant. No workspace, no rows."""
    if not workspace_id:
        return rows.where(F.lit(False))
    return rows.where(F.col("workspace_id") == workspace_id)
