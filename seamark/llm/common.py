"""Small helpers the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamark.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIEVE_WORDS = 1 << 20  # 64 bits each
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: work done once, and no lost executor undoes it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(df: DataFrame) -> None:
    """Delete a table of :func:`shared_table` once everything that reads it is written."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(checkpoint_root(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not files.makeQualified(hadoop(folder).getParent()).equals(files.makeQualified(root)):
            raise ValueError(f"{folder} is not a table in the shared folder")
        files.delete(hadoop(folder), True)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Mark a *stored* table of narrow rows for broadcast if it has at most ``rows`` rows; beyond that joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matching(df: DataFrame, keys: DataFrame, name: str, rows: int) -> DataFrame:
    """The rows of ``df`` whose ``name``, a 64-bit hash, is in the *stored* table ``keys`` (``name``, distinct), broadcast if it has at
    most ``rows`` rows. Beyond that a broadcast sieve of ``SIEVE_WORDS`` times 64 bits, in which every key has its bit, goes first:
    of the other rows it lets as many through as it has bits set, so the join shuffles few more rows than it returns."""
    if keys.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(keys), name)
    word = F.pmod(name, F.lit(SIEVE_WORDS)).alias("__word")
    bit = F.pmod(F.shiftright(name, 32), F.lit(64)).cast("int")
    set_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    sieve = shared_table(keys.groupBy(word).agg(F.bit_or(set_bit).alias("__bits")), "sieve")
    passed = df.join(F.broadcast(sieve), word == F.col("__word")).where(F.col("__bits").bitwiseAND(set_bit) != 0)
    return passed.drop("__word", "__bits").join(keys, name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` where no other character of the text could change, as it is faster."""
    others = text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Zs}\p{Sc}\p{M}]")
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, between: str) -> Column:
    """The words of a text without the empty strings at its ends; null gives an empty array."""
    parts = F.split(text, between)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def document_key(text: Column) -> Column:
    """With doc_id it names a row; rows equal in both are one document whose copies all get its result."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as one expression, so that it needs no Python worker."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
