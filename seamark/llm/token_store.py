"""Token ids in shards of raw payload, with a minimal perfect hash index from document key to place.

Layout of a store (all Parquet, written by Spark, so any file system that Spark knows will do):

* ``payload``: (shard, block, start, first_row, payload): ids of consecutive documents in ascending key order, unsigned
  and little-endian, 2 bytes each if the vocabulary allows it, else 4; ``start`` counts the ids of the shard before it;
  ``keys`` and ``lengths`` name the documents of the block. A block is closed beyond ``BLOCK_BYTES``.
* ``shards``: (shard, rows, tokens, before): ``before`` counts the ids of all shards before it.
* ``index``: one row per bucket of keys: the levels of a minimal perfect hash (Limasset et al., 2017) as bit arrays, and
  at each key's slot a stored fingerprint, shard, block, row, number of rows, and runs of the key.

A lookup hashes the key, tests a bit per level (1.6 on average), takes the rank of the bit as the slot and compares the
fingerprint: constant time, and no key is stored in the index. Rows of one key that fill several blocks are runs with a
slot each, all in the key's bucket.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seamark.llm.common import document_key
from seamark.llm.tokens import encoder
from seamark.session import checkpoint_root

BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 32_768
BUCKET = 50_000   # index entries aimed at in a bucket
SPREAD = 1.5      # bits per key on a level
PAYLOAD = ("shard int, block int, start bigint, tokens bigint, keys array<bigint>, lengths array<int>, payload binary")
INDEX = ("bucket bigint, entries bigint, levels array<bigint>, bits binary, fingerprint binary, shard binary, block binary, "
         "row binary, copies binary, runs binary")
NULL_KEY = -0x5EA3A2C0FFEE  # a null key is hashed as this number; who asks says which of the two is meant, and the payload which it is


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """The finaliser of splitmix64 after adding a salt."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def entry_hash(keys: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64), 1) + runs.astype(np.uint64), 2)


def build_levels(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits in a row; on a level the hashes without a rival set their bit, others go on."""
    sizes, bits = [], []
    while len(hashes):
        if len(sizes) == 64:
            raise ValueError("two keys have the same 64-bit hash")
        size = max(64, int(SPREAD * len(hashes)))
        place = (mix(hashes, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size), bits.append(alone)
        hashes = hashes[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(hashes: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each hash, 0 to entries - 1; -1 where no level has its bit. Absent keys may get a slot, too."""
    rank = np.cumsum(bits)
    slots = np.full(len(hashes), -1)
    todo, base = np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        place = base + (mix(hashes[todo], 100 + level) % np.uint64(size)).astype(np.int64)
        hit = bits[place]
        slots[todo[hit]] = rank[place[hit]] - 1
        todo, base = todo[~hit], base + size
    return slots


@dataclass(frozen=True)
class Store:
    path: str
    width: int
    spark: SparkSession

    @property
    def payload(self) -> DataFrame:
        return self.spark.read.schema(PAYLOAD).parquet(f"{self.path}/payload")

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
                path: str | None = None, shards: int | None = None) -> Store:
    """Encode every whole text, add ``end_id``, and write payload, shards and index below ``path``.

    Null and empty texts are one id. Null keys come first. Repeated keys are kept, ordered by the hash of their texts.
    An empty table gives an empty store. Other columns are not read. A lost task is run again and its shard written
    whole or not at all, as Spark's writer commits it.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    path = path or f"{checkpoint_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16 else 4
    rows = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).alias("text"), document_key(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange(count, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    end = end_id.to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        block, start, keys, lengths, parts, size = 0, 0, [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start, "tokens": len(ids), "keys": keys,
                                                "lengths": lengths, "payload": ids.astype(f"<u{width}").tobytes()}], schema=schema)

        for batch in batches:
            for key, body in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(body) + end
                keys.append(key), lengths.append(len(ids) // 4), parts.append(ids)
                size += len(ids) // 4
                if size * width >= BLOCK_BYTES or len(keys) >= BLOCK_ROWS:
                    yield close()
                    block, start, keys, lengths, parts, size = block + 1, start + size, [], [], [], 0
        if keys:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
    ordered.mapInArrow(blocks, PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
    store = Store(path, width, spark)
    totals = store.payload.groupBy("shard").agg(F.sum(F.size("keys").cast("bigint")).alias("rows"), F.sum("tokens").alias("tokens"))
    # One row per shard, so the running sum in one task has as many rows as the write had tasks.
    totals.withColumn("before", F.coalesce(F.sum("tokens").over(
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{path}/shards")
    _write_index(store)
    return store


def _write_index(store: Store) -> None:
    runs = store.payload.select("shard", "block", F.posexplode("keys").alias("row", "key")).groupBy("shard", "block", "key").agg(
        F.min("row").alias("row"), F.count("*").cast("int").alias("copies")).withColumn("key", F.coalesce("key", F.lit(NULL_KEY)))
    rows = store.shards.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET))

    def build(entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values(["key", "shard", "block"])
        run = entries.groupby("key").cumcount().to_numpy()
        total = entries.groupby("key")["row"].transform("size").to_numpy()
        hashes = entry_hash(entries["key"].to_numpy(), run)
        sizes, bits = build_levels(hashes)
        order = np.empty(len(entries), int)
        order[find_slots(hashes, sizes, bits)] = np.arange(len(entries))

        def column(values) -> bytes:
            return np.asarray(values)[order].astype("<u4").tobytes()

        return pd.DataFrame([{
            "bucket": entries["bucket"].iloc[0], "entries": len(entries), "levels": sizes, "bits": np.packbits(bits).tobytes(),
            "fingerprint": column(mix(hashes, 3) >> np.uint64(32)), "runs": column(total),
            **{c: column(entries[c]) for c in ("shard", "block", "row", "copies")}}])[[c.split()[0] for c in INDEX.split(", ")]]

    (runs.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, INDEX)
     .write.option("compression", "zstd").parquet(f"{store.path}/index"))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets))


def locate(store: Store, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, none, shard, block, row, copies) of every distinct key that the index may know: a false one passes once in 2**32,
    and ``NULL_KEY`` and a null key (``none``) are told apart by the payload."""
    rows = store.shards.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET))
    asked = keys.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("key"), F.col(key).isNull().alias("none")).distinct().withColumn(
        "bucket", bucket_of(buckets))
    form = "key bigint, none boolean, shard int, block int, row int, copies int"
    names = [c.split()[0] for c in form.split(", ")]

    def look(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(index):
            return pd.DataFrame({n: [] for n in names}).astype("int64").astype({"none": bool})
        entry = index.iloc[0]
        sizes = [int(x) for x in entry["levels"]]
        bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
        column = {c: np.frombuffer(entry[c], "<u4") for c in ("fingerprint", "shard", "block", "row", "copies", "runs")}
        found, wanted, none, run = [], asked["key"].to_numpy(np.int64), asked["none"].to_numpy(bool), 0
        while len(wanted):
            hashes = entry_hash(wanted, np.full(len(wanted), run))
            slots = find_slots(hashes, sizes, bits)
            good = slots >= 0
            good[good] = column["fingerprint"][slots[good]] == (mix(hashes[good], 3) >> np.uint64(32)).astype(np.uint32)
            wanted, none, slots = wanted[good], none[good], slots[good]
            found.append(pd.DataFrame({"key": wanted, "none": none, **{c: column[c][slots].astype(np.int64) for c in names[2:]}}))
            run += 1
            more = column["runs"][slots] > run
            wanted, none = wanted[more], none[more]
        return pd.concat(found)[names]

    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInPandas(look, form)


def fetch(store: Store, keys: DataFrame, key: str = "key", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every stored row of the keys, read from the payload at its place.

    ``start`` counts the ids of all rows before it; ``ids`` are little-endian unsigned 32-bit integers (null unless asked
    for). Keys that the store lacks give no row: a false hit of the fingerprint shows as another key in the block.
    """
    width = store.width
    wanted = locate(store, keys, key).groupBy("shard", "block").agg(
        F.collect_list(F.struct("key", "none", "row", "copies")).alias("wanted"))  # at most BLOCK_ROWS in a block
    found = store.payload.join(F.broadcast(store.shards.select("shard", "before")), "shard").join(wanted, ["shard", "block"]).select(
        (F.col("before") + F.col("start")).alias("start"), "keys", "lengths", "payload", "wanted")
    form = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = {n: batch.column(n)[at] for n in batch.schema.names}
                keys, ends = block["keys"].as_py(), np.cumsum(block["lengths"].values.to_numpy())
                ids = np.frombuffer(block["payload"].as_buffer(), f"<u{width}").astype("<u4")
                out = []
                for w in block["wanted"].as_py():
                    if keys[w["row"]] != (None if w["none"] else w["key"]):
                        continue
                    for row in range(w["row"], w["row"] + w["copies"]):
                        first = int(ends[row - 1]) if row else 0
                        own = ids[first:ends[row]].tobytes()
                        out.append((keys[row], block["start"].as_py() + first, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form)], schema=form)

    return found.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
