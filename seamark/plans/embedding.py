"""Queries of the embedding jobs."""

from pyspark.sql import functions as F

from seamark.functions.vectors import norm
from seamark.operators.embedding import (HashEmbedder, compare_embeddings, embed, embed_usage, missing_vectors,
                                         embed_queries, needed_profiles, reuse_by_content, reuse_by_preparation, validate_vectors)
from seamark.plans.registry import query
from seamark.profiles import PROFILES


@query("hash_embed")
def hash_embed(t):
    """Every document embedded by the default model."""
    rows = embed(t.raw("documents").select("doc_id", F.col("text").alias("input")), lambda: HashEmbedder(64))
    return rows.select("doc_id", "token_count", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 4).alias("norm"))


@query("normalize_vectors", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN embedding[1:63] WHEN vec_id % 10 = 4 THEN list_transform(embedding, lambda x: 0.0)
  ELSE list_transform(embedding, lambda x: CAST(x * (label + 1) AS FLOAT)) END AS e FROM embeddings),
n AS (SELECT *, CASE WHEN len(e) <> 64 THEN 'DIMENSION_MISMATCH' WHEN vec_id % 10 IN (4, 5) THEN 'NON_FINITE_EMBEDDING' END AS error_code,
  sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) AS l FROM v)
SELECT vec_id, error_code, CASE WHEN error_code IS NULL THEN round(CAST(CAST(e[1] / l AS FLOAT) AS DOUBLE), 5) END AS first_value FROM n""")
def normalize_vectors(t):
    e, n = F.col("embedding"), F.col("vec_id") % 10
    scaled = F.transform(e, lambda x: (x * (F.col("label") + 1)).cast("float"))
    broken = (F.when(n == 3, F.slice(e, 1, 63)).when(n == 4, F.transform(e, lambda x: F.lit(0.0).cast("float")))
              .when(n == 5, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).otherwise(scaled))
    checked = validate_vectors(t.raw("embeddings").withColumn("embedding", broken), 64)
    return checked.select("vec_id", "error_code", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"))


@query("reuse_by_content", """
WITH done AS (SELECT DISTINCT version_id FROM p1),
src AS (SELECT sha256, filename, min(version_id) AS source_version FROM versions WHERE version_id IN (SELECT version_id FROM done)
        GROUP BY ALL)
SELECT v.version_id, s.source_version, p.token_count FROM versions v JOIN src s USING (sha256, filename)
JOIN p1 p ON p.version_id = s.source_version WHERE v.version_id NOT IN (SELECT version_id FROM done)""")
def reuse_by_content_query(t):
    return reuse_by_content(t.versions.select("version_id"), t.versions, t.segments, "p1").select(
        "version_id", "source_version", "token_count")


def preparations(t):
    rows = [("p1", "m", "r", "f", {"image": "280", "audio": "30/0", "video": "30/0"}),
            ("p2", "m", "r", "f", {"image": "280", "audio": "30/5", "video": "30/0"})]
    return t.spark.createDataFrame(
        rows, "profile_id string, model string, revision string, dtype string, preparation map<string,string>")


@query("reuse_by_preparation", """
SELECT v.version_id, p.segment_id AS source_segment, p.token_count FROM versions v JOIN p1 p ON p.version_id = v.version_id
WHERE v.media_type IN ('image/png', 'video/mp4') AND v.version_id NOT IN (SELECT version_id FROM segments WHERE profile_id = 'p2')""")
def reuse_by_preparation_query(t):
    named = t.segments.withColumn("source_segment", F.col("segment_id"))
    return reuse_by_preparation(t.versions.select("version_id"), t.versions, named, preparations(t), "p2").select(
        "version_id", "source_segment", "token_count")


@query("missing_vectors", """
SELECT store_id, file_id, version_id FROM members WHERE version_id NOT IN (SELECT version_id FROM segments WHERE profile_id = 'p2')""")
def missing_vectors_query(t):
    return missing_vectors(t.members, t.segments, "p2").select("store_id", "file_id", "version_id")


@query("needed_profiles", """
WITH reached AS (SELECT store_id, store_id AS idx FROM stores WHERE deleted_at IS NULL UNION ALL
  SELECT parent, store_id FROM (SELECT store_id, unnest(parents) AS parent FROM views WHERE NOT gone))
SELECT DISTINCT sf.file_id, r.profile_id FROM store_files sf JOIN reached x ON x.store_id = sf.store_id
JOIN revisions r ON r.store_id = x.idx AND r.state IN ('active', 'building', 'ready')""")
def needed_profiles_query(t):
    return needed_profiles(t.files, t.store_files, t.stores, t.revisions)


@query("compare_embeddings", """
WITH c AS (SELECT 1 - round(list_cosine_distance(a.embedding, CASE WHEN a.doc_id % 50 = 7 THEN list_transform(a.embedding,
  lambda x, i: CASE WHEN i = 1 THEN x + 0.5 ELSE x END) ELSE list_transform(a.embedding, lambda x: x * 2) END), 12) AS c FROM segments a)
SELECT count(*) AS pairs, round(min(c), 6) AS min_cosine, coalesce(bool_and(c >= 0.9999), true) AS equivalent FROM c""")
def compare_embeddings_query(t):
    nudged = F.transform("embedding", lambda x, i: F.when(i == 0, x.cast("double") + 0.5).otherwise(x.cast("double")))
    other = t.segments.withColumn("embedding", F.when(F.col("doc_id") % 50 == 7, nudged).otherwise(
        F.transform("embedding", lambda x: x.cast("double") * 2)))
    return compare_embeddings(t.segments, other).withColumn("min_cosine", F.round("min_cosine", 6))


@query("embed_usage", """
SELECT version_id, profile_id, kind, CAST(quantity AS BIGINT) AS quantity, kind || ':' || version_id || ':' || profile_id AS idem_key FROM (
  SELECT version_id, profile_id, CASE WHEN modality = 'text' THEN 'index_text_tokens' ELSE 'index_media_tokens' END AS kind,
  sum(token_count) AS quantity FROM segments GROUP BY ALL) WHERE quantity > 0""")
def embed_usage_query(t):
    return embed_usage(t.segments).select("version_id", "profile_id", "kind", "quantity", "idem_key")


_PROMPTED = f"""asked AS (SELECT 'q' || d.doc_id AS query_id, d.workspace_id, len(regexp_extract_all('{PROFILES["p1"].query_prompt}' || d.text, '\\S+')) AS tokens
  FROM docs d WHERE d.text IS NOT NULL)"""


def _asked(t):
    """Every document's text as a question of its workspace."""
    return embed_queries(t.docs.where("text is not null").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), "workspace_id", "text"),
                         PROFILES["p1"], lambda: HashEmbedder(64))


@query("embed_queries", f"""WITH {_PROMPTED}
SELECT query_id, workspace_id, CAST(tokens AS INTEGER) AS token_count, 64 AS dims, 1.0::DOUBLE AS norm, CAST(NULL AS VARCHAR) AS error_code FROM asked""")
def embed_queries_query(t):
    vectors, _ = _asked(t)
    return vectors.select("query_id", "workspace_id", "token_count", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 4).alias("norm"),
                          "error_code")


@query("query_usage", f"""WITH {_PROMPTED}
SELECT workspace_id, 'query_text_tokens' AS kind, CAST(sum(tokens) AS BIGINT) AS quantity FROM asked GROUP BY workspace_id""")
def query_usage(t):
    return _asked(t)[1]
