"""Embedding jobs: run a model over batches, check vectors, plan what must be computed, reuse what exists."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.functions.ids import segment_id
from seamark.functions.vectors import cosine_distance, normalized, vector_error
from seamark.functions.text import pieces, query_input
from seamark.profiles import Profile
from seamark.session import cut_lineage, dealt

BATCH = 16  # fixed value: inputs per model call


class Embedder(Protocol):
    """The model of the user: texts to a float32 matrix and the tokens of each text."""

    dims: int

    def embed(self, texts: list[str]) -> tuple[np.ndarray, list[int]]: ...


class HashEmbedder:
    """Feature hashing of words and word pairs to a fixed number of signed buckets. Needs no model files."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        out, tokens = np.zeros((len(texts), self.dims), dtype=np.float32), []
        for row, text in enumerate(texts):
            words = text.lower().split()
            tokens.append(len(words))
            features = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
            codes = np.fromiter((zlib.crc32(f.encode("utf-8")) for f in features), dtype=np.int64, count=len(features))
            np.add.at(out[row], codes % self.dims, np.where(codes >> 31, -1.0, 1.0))
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths == 0, 1, lengths), tokens


def embed(df: DataFrame, make_embedder: Callable[[], Embedder], text: str = "input", batch: int = BATCH) -> DataFrame:
    """Add ``embedding`` and ``token_count``. The model is loaded once per task and called on ``batch`` texts."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in (part for whole in batches for part in pieces(whole, text)):
            model = model or make_embedder()
            texts = [t or "" for t in rows.column(text).to_pylist()]
            vectors, tokens = [], []
            for at in range(0, len(texts), batch):
                found, used = model.embed(texts[at:at + batch])
                vectors.append(np.asarray(found, dtype=np.float32))
                tokens.extend(used)
            flat = np.concatenate(vectors).ravel() if vectors else np.zeros(0, dtype=np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * model.dims
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(tokens, pa.int32())],
                                             names=[*rows.schema.names, "embedding", "token_count"])

    return dealt(df, text).mapInArrow(kernel, f"{fields}, embedding array<float>, token_count int")


def embed_queries(queries: DataFrame, profile: Profile, make_embedder: Callable[[], Embedder], batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(query vectors, usage) of a table of questions.

    ``queries(query_id, workspace_id, text)``: each question goes through the profile's prompt, the model and the check of
    vectors: (query_id, workspace_id, embedding, token_count, error_code). Usage is one fact per workspace and kind, for the
    questions that got a vector; a null text is an empty question. The vectors are stored, so the model runs once.
    """
    asked = queries.select("query_id", "workspace_id", query_input(profile.query_prompt, F.coalesce("text", F.lit(""))).alias("input"))
    made = embed(asked, make_embedder, batch=batch).drop("input").withColumn("error_code", vector_error(F.col("embedding"), F.size("embedding")))
    vectors = cut_lineage(made)
    usage = vectors.where("error_code is null").groupBy("workspace_id").agg(F.sum("token_count").cast("bigint").alias("quantity"))
    return vectors, usage.select("workspace_id", F.lit("query_text_tokens").alias("kind"), "quantity").where("quantity > 0")


def validate_vectors(df: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Add ``error_code`` and replace good vectors by their unit-length form."""
    checked = df.withColumn("error_code", vector_error(F.col(column), dims))
    return checked.withColumn(column, F.when(F.col("error_code").isNull(), normalized(F.col(column))))


def missing_vectors(members: DataFrame, segments: DataFrame, profile_id: str) -> DataFrame:
    """Members without any segment for the profile."""
    done = segments.where(F.col("profile_id") == profile_id).select("version_id")
    return members.join(done, "version_id", "left_anti")


def _rekeyed(copies: DataFrame, segments: DataFrame, profile_id: str) -> DataFrame:
    """Segments of ``source_version`` under the ids of ``version_id``; no tokens are charged for them."""
    source = segments.withColumnRenamed("version_id", "source_version").withColumnRenamed("profile_id", "source_profile")
    on = ["source_version", "source_profile"] if "source_profile" in copies.columns else ["source_version"]
    rows = copies.join(source, on)
    return (rows.withColumn("profile_id", F.lit(profile_id))
            .withColumn("segment_id", segment_id(F.col("version_id"), F.col("profile_id"), F.col("ordinal"))))


def reuse_by_content(wanted: DataFrame, versions: DataFrame, segments: DataFrame, profile_id: str) -> DataFrame:
    """Copy vectors for ``wanted(version_id)`` from another version with the same bytes and file name.

    The source per content is chosen by a map-side combined minimum, so a content with very many copies stays cheap.
    """
    of_profile = segments.where(F.col("profile_id") == profile_id)
    done = of_profile.select("version_id").distinct()
    content = ["sha256", "filename"]
    sources = (versions.join(done, "version_id", "left_semi").groupBy(*content)
               .agg(F.min("version_id").alias("source_version")))
    todo = versions.join(wanted.select("version_id"), "version_id", "left_semi").join(done, "version_id", "left_anti")
    copies = todo.select("version_id", *content).join(sources, content).select("version_id", "source_version")
    return _rekeyed(copies, of_profile.drop("segment_id", "profile_id"), profile_id)


# Media types whose segments depend on one preparation entry only.
SINGLE_PREPARATION = {"image/jpeg": "image", "image/png": "image", "audio/wav": "audio", "audio/mpeg": "audio",
                      "video/mp4": "video"}


def reuse_by_preparation(wanted: DataFrame, versions: DataFrame, segments: DataFrame, profiles: DataFrame,
                         profile_id: str) -> DataFrame:
    """Copy vectors of the same version from another profile with equal model, revision, dtype and preparation.

    ``profiles(profile_id, model, revision, dtype, preparation MAP<STRING,STRING>)``; the entry compared is the one of
    the version's media type. Text and page documents are never reused this way.
    """
    target = profiles.where(F.col("profile_id") == profile_id).select(
        *[F.col(c).alias("t_" + c) for c in ("model", "revision", "dtype", "preparation")])
    same_model = ((F.col("model") == F.col("t_model")) & (F.col("revision") == F.col("t_revision"))
                  & (F.col("dtype") == F.col("t_dtype")))
    entries = F.explode(F.map_entries(F.col("preparation"))).alias("p")
    twins = (profiles.where(F.col("profile_id") != profile_id).join(target, same_model)
             .select(F.col("profile_id").alias("source_profile"), entries, "t_preparation")
             .where(F.try_element_at("t_preparation", F.col("p.key")) == F.col("p.value"))
             .select("source_profile", F.col("p.key").alias("prep_key")))
    key = F.lit(None).cast("string")
    for kind, name in SINGLE_PREPARATION.items():
        key = F.when(F.col("media_type") == kind, name).otherwise(key)
    done = segments.where(F.col("profile_id") == profile_id).select("version_id")
    todo = (versions.join(wanted.select("version_id"), "version_id", "left_semi")
            .join(done, "version_id", "left_anti").select("version_id", key.alias("prep_key"))
            .where(F.col("prep_key").isNotNull()))
    have = segments.groupBy("version_id", "profile_id").agg(F.lit(1).alias("one")).select(
        "version_id", F.col("profile_id").alias("source_profile"))
    copies = (todo.join(have, "version_id").join(twins, ["source_profile", "prep_key"])
              .groupBy("version_id").agg(F.min("source_profile").alias("source_profile"))
              .withColumn("source_version", F.col("version_id")))
    return _rekeyed(copies, segments.drop("segment_id"), profile_id)


def needed_profiles(files: DataFrame, store_files: DataFrame, stores: DataFrame, revisions: DataFrame) -> DataFrame:
    """(file_id, profile_id) of every live index that will hold the file: its stores and the views right over them."""
    live = stores.where(F.col("deleted_at").isNull())
    open_revisions = revisions.where(F.col("state").isin("active", "building", "ready")).select("store_id", "profile_id")
    views = live.where("kind = 'view'").select(F.col("store_id").alias("view_id"),
                                               F.explode("definition.parents").alias("store_id"))
    reached = (live.select("store_id", F.col("store_id").alias("index_store"))
               .unionByName(views.select("store_id", F.col("view_id").alias("index_store"))))
    wanted = (reached.join(open_revisions.withColumnRenamed("store_id", "index_store"), "index_store")
              .select("store_id", "profile_id").distinct())
    members = store_files.select("store_id", "file_id").join(files.select("file_id"), "file_id", "left_semi")
    return members.join(wanted, "store_id").select("file_id", "profile_id").distinct()


def compare_embeddings(a: DataFrame, b: DataFrame, min_cosine: float = 0.9999) -> DataFrame:
    """One row: pairs compared, lowest cosine, whether every pair reaches ``min_cosine``."""
    left = a.select("segment_id", F.col("embedding").alias("va"))
    right = b.select("segment_id", F.col("embedding").alias("vb"))
    cosine = F.lit(1.0) - cosine_distance(F.col("va"), F.col("vb"))
    return left.join(right, "segment_id").select(cosine.alias("cosine")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("cosine").alias("min_cosine"),
        F.coalesce(F.bool_and(F.col("cosine") >= min_cosine), F.lit(True)).alias("equivalent"))


def embed_usage(segments: DataFrame) -> DataFrame:
    """Usage facts of an embedding run: text and media tokens per (version, profile), each with its idempotency key."""
    text = F.sum(F.when(F.col("modality") == "text", F.col("token_count")).otherwise(0))
    media = F.sum(F.when(F.col("modality") != "text", F.col("token_count")).otherwise(0))
    sums = segments.groupBy("version_id", "profile_id").agg(text.alias("t"), media.alias("m"))
    kinds = F.explode(F.array(F.struct(F.lit("index_text_tokens").alias("kind"), F.col("t").alias("quantity")),
                              F.struct(F.lit("index_media_tokens").alias("kind"), F.col("m").alias("quantity"))))
    return (sums.select("version_id", "profile_id", kinds.alias("u"))
            .select("version_id", "profile_id", "u.kind", "u.quantity").where("quantity > 0")
            .withColumn("idem_key", F.concat_ws(":", "kind", "version_id", "profile_id")))
