"""Session defaults and the few runtime helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings that suit corpus jobs at any size. Shuffle partitions start high and AQE merges the small ones, so the
# same plan fits 1 GB and 100 TB; skewed sort-merge joins are split at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.parquet.filterPushdown": "true",
}
DEALT_BYTES = 32_000_000  # of text that one task is dealt


def build_session(app: str = "seamark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the corpus defaults; ``master`` is only given in tests and benches."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; their Python workers import it for the Arrow kernels."""
    sc = spark.sparkContext
    if getattr(sc, "_seamark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seamark-")) / "seamark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._seamark_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; on a local master (tests) one is made if none is named, elsewhere that raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    fallback = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor never costs a long recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, but as compressed columns: for tables of many rows."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Store a result and mark it for broadcast if it has at most ``max_rows`` rows; otherwise joins shuffle as usual.

    The size is known before the join is planned, so a big table on the other side is never shuffled for a small one.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def dealt(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """A table of fewer files than the cluster has cores (one file may be one unsplittable part) is dealt to all of them
    before Python works through its texts, and to more tasks where one would get over ``DEALT_BYTES`` of them (``size`` bytes
    in all, counted if not given); larger tables stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) if size is None else size
    return df.repartition(max(cores, -(-size // DEALT_BYTES)))
