"""The catalogue tables derived from the given test tables: once as DataFrames, once as the same thing in SQL.

Every table grows with the given ones; only the few store definitions are settings.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamark.functions.metadata import literal
from seamark.functions.text import STOP_WORDS, identifiers
from seamark.operators.term_index import buckets_for, open_term_index, text_bytes
from seamark.schemas import LIMITS, STORE_DEFINITION
from seamark.session import bounded
from seamark.sources.files import media_type

EPOCH = "2024-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"
CUTOFF = "2024-01-20 00:00:00"
MAX_LABELS = 1_000_000  # labels of vectors that may be broadcast

VIEWS = [  # store_id, parents, metadata key, value, path prefix, media types, depth, deleted
    ("v_en", ["src0", "src1", "src2", "src19"], "lang", "en", None, None, 1, False),
    ("v_good", ["src1", "src3", "snap"], "quality", 1, None, None, 1, False),
    ("v_deep", ["v_en", "src4"], None, None, "src", ["text/plain", "text/markdown", "image/png"], 2, False),
    ("v_top", ["v_deep", "v_good"], None, None, None, None, 3, False),
    ("v_gone", ["src6"], None, None, None, None, 1, True),
]


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def minutes_after(text: str, minutes: Column) -> Column:
    return ntz(text) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


class Tables:
    """Bound tables of one test folder. Built lazily; a query only reads what it touches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        """Documents with the facts the other tables share."""
        d = self.raw("documents")
        kind = F.col("n_chars") % 10
        ext = (F.when(kind <= 4, ".txt").when(kind == 5, ".md").when(kind == 6, ".pdf").when(kind == 7, ".png")
               .when(kind == 8, ".mp3").otherwise(".mp4"))
        doc = F.col("doc_id").cast("string")
        return (d.withColumn("ext", ext).withColumn("filename", F.concat("lang", "ext"))
                .withColumn("file_id", F.concat(F.lit("f"), doc))
                .withColumn("path", F.concat_ws("/", "source", doc, "filename"))
                .withColumn("last_no", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1))
                .withColumn("workspace_id", F.concat(F.lit("w"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")))
                .withColumn("created_at", minutes_after(EPOCH, F.col("doc_id").cast("int"))))

    @cached_property
    def files(self) -> DataFrame:
        d = self.docs.join(self.raw("labels"), "doc_id", "left")
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        meta = F.map_filter(F.create_map(
            F.lit("lang"), quoted(F.col("lang")), F.lit("source"), quoted(F.col("source")),
            F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")),
            lambda _, v: v.isNotNull())
        current = F.when(F.col("doc_id") % 23 != 7, F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("-"),
                                                            F.col("last_no").cast("string")))
        deleted = F.when(F.col("doc_id") % 17 == 3, F.col("created_at") + F.expr("interval 5 days"))
        return d.select("workspace_id", "file_id", "path", current.alias("current_version_id"), meta.alias("metadata"),
                        "created_at", F.col("created_at").alias("updated_at"), deleted.alias("deleted_at"), "doc_id")

    @cached_property
    def versions(self) -> DataFrame:
        return self.bodies.drop("content")

    @cached_property
    def bodies(self) -> DataFrame:
        """The versions with the bytes of each."""
        no = F.explode(F.sequence(F.lit(1), F.col("last_no")))
        d = self.docs.withColumn("version_no", no)
        body = F.when(F.col("version_no") == 1, F.col("text")).otherwise(F.concat("text", F.lit("\nrevised")))
        return d.select("workspace_id", F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("-"),
                                                 F.col("version_no").cast("string")).alias("version_id"),
                        "file_id", "version_no", F.sha2(body.cast("binary"), 256).alias("sha256"),
                        F.octet_length(body).cast("long").alias("size"), "filename",
                        media_type(F.col("filename")).alias("media_type"),
                        (F.col("created_at") + F.make_dt_interval(F.col("version_no") * 2 - 2)).alias("created_at"), "doc_id",
                        body.cast("binary").alias("content"))

    @cached_property
    def segments(self) -> DataFrame:
        """One segment per document in profile p1, and in p2 for every third; a document without a vector is text."""
        return self._segments(self.raw("embeddings"))

    @cached_property
    def passages(self) -> DataFrame:
        """The segments of p1 without their vectors, for work on texts: the labels alone are joined, and as long as they are few
        enough to be broadcast the texts stay where they are read."""
        labels = bounded(self.raw("embeddings").select("vec_id", "label"), MAX_LABELS)
        return self._segments(labels.withColumn("embedding", F.lit(None).cast("array<float>"))).where("profile_id = 'p1'")

    def _segments(self, vectors: DataFrame) -> DataFrame:
        d = self.docs.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
        profile = F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(
            F.array(F.lit("p1"))))
        modality = (F.when(F.col("label").isNull() | (F.col("label") <= 5), "text").when(F.col("label") <= 7, "image")
                    .when(F.col("label") == 8, "audio").otherwise("video"))
        d = d.withColumn("profile_id", profile).withColumn("modality", modality)
        is_text = F.col("modality") == "text"
        timed = F.col("modality").isin("audio", "video")
        location = F.struct(
            F.when(is_text, F.lit(0)).alias("start"), F.when(is_text, F.col("n_chars").cast("int")).alias("end"),
            F.when((F.col("doc_id") % 4 == 1) & ~timed, (F.col("doc_id") % 9 + 1).cast("int")).alias("page"),
            F.when(is_text & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Part "), F.col("lang"))).alias("section"),
            F.when(timed, F.lit(0.0)).alias("start_seconds"),
            F.when(timed, (F.col("n_chars") % 60).cast("double")).alias("end_seconds"),
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("type"))
        pad = F.lpad(F.col("doc_id").cast("string"), 10, "0")
        return d.select("workspace_id", F.concat(F.lit("s"), F.substring("profile_id", 2, 1), pad).alias("segment_id"),
                        F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("-"),
                                 F.col("last_no").cast("string")).alias("version_id"),
                        "profile_id", F.lit(0).alias("ordinal"), "modality", location.alias("location"),
                        F.when(is_text, F.col("text")).alias("content"),
                        F.floor(F.col("n_chars") / 4).cast("int").alias("token_count"), "embedding", "label", "doc_id")

    @cached_property
    def p1(self) -> DataFrame:
        return self.segments.where("profile_id = 'p1'")

    @cached_property
    def stores(self) -> DataFrame:
        none = F.lit(None).cast(STORE_DEFINITION)
        base = self.raw("documents").select(F.col("source").alias("store_id")).distinct().select(
            "store_id", F.concat(F.lit("Store "), F.col("store_id")).alias("name"), F.lit("material").alias("kind"),
            none.alias("definition"), F.when(F.col("store_id") == "src19", ntz("2024-01-10 00:00:00")).alias("deleted_at"))
        rows = [("snap", "Snapshot", "snapshot", None, False)]
        for sid, parents, key, value, prefix, kinds, depth, gone in VIEWS:
            meta = {} if key is None else {key: literal(value)}
            rows.append((sid, "View " + sid, "view", (parents, (meta, prefix, kinds), depth), gone))
        schema = "store_id string, name string, kind string, definition " + STORE_DEFINITION.simpleString() + ", gone boolean"
        derived = self.spark.createDataFrame(rows, schema)
        return base.unionByName(derived.withColumn("deleted_at", F.when(F.col("gone"), ntz("2024-01-11 00:00:00")))
                                .drop("gone")).withColumn("active_revision_id", F.concat(F.lit("r1-"), F.col("store_id")))

    @cached_property
    def store_files(self) -> DataFrame:
        n, doc = F.col("doc_id"), F.col("doc_id").cast("string")
        neighbour = F.concat(F.lit("src"), ((F.substring("source", 4, 9).cast("int") + 1) % 20).cast("string"))
        held = lambda store, pin: F.struct(store.alias("store_id"), pin.cast("string").alias("pinned_version_id"))
        rows = F.array_compact(F.array(
            held(F.col("source"), F.lit(None)), F.when(n % 11 == 0, held(neighbour, F.lit(None))),
            F.when(n % 9 == 0, held(F.lit("snap"), F.concat(F.lit("v"), doc, F.lit("-1"))))))
        return self.docs.select("file_id", F.explode(rows).alias("h")).select("h.store_id", "file_id", "h.pinned_version_id")

    @cached_property
    def revisions(self) -> DataFrame:
        """Every store has an active p1 index; p2 indexes are ready or building."""
        s = self.stores.select("store_id")
        number = F.length("store_id") % 2
        return s.select(F.concat(F.lit("r1-"), F.col("store_id")).alias("revision_id"), "store_id",
                        F.lit("p1").alias("profile_id"), F.lit("active").alias("state")).unionByName(
            s.select(F.concat(F.lit("r2-"), F.col("store_id")).alias("revision_id"), "store_id",
                     F.lit("p2").alias("profile_id"), F.when(number == 0, "ready").otherwise("building").alias("state")))

    @cached_property
    def members(self) -> DataFrame:
        from seamark.operators.stores import resolve_all
        return resolve_all(self.stores, self.store_files, self.files, self.versions)

    @cached_property
    def direct(self) -> DataFrame:
        from seamark.operators.stores import members_direct
        return members_direct(self.stores, self.store_files, self.files, self.versions)

    @cached_property
    def blobs(self) -> DataFrame:
        v = self.versions
        return v.groupBy("workspace_id", "sha256").agg(F.min("size").alias("size"), F.min("created_at").alias("created_at"))

    @cached_property
    def items(self) -> DataFrame:
        e = self.raw("events")
        n = F.col("event_id")
        state = (F.when(F.col("event_type") == "error", "failed")
                 .when((F.col("event_type") == "purchase") & (n % 5 == 0), "cancelled")
                 .when((F.col("event_type") == "signup") & (n % 4 == 0), "queued")
                 .when((F.col("event_type") == "click") & (n % 9 == 0), "running").otherwise("succeeded"))
        retryable = (F.col("event_type") == "error") & (n % 2 == 0)
        return e.select(F.concat(F.lit("i"), n.cast("string")).alias("item_id"),
                        F.concat(F.lit("j"), F.floor(n / 7).cast("string")).alias("job_id"),
                        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_id"),
                        F.concat(F.lit("v"), F.col("user_id").cast("string"), F.lit("-1")).alias("version_id"),
                        F.concat(F.lit("up/"), n.cast("string"), F.lit(".txt")).alias("path"), state.alias("state"),
                        retryable.alias("retryable"),
                        F.when(retryable, "SERVICE_UNAVAILABLE").when(F.col("event_type") == "error", "UNREADABLE")
                        .alias("error_code"), F.lit("failed").alias("error_message"), F.col("ts").alias("updated_at"))

    @cached_property
    def jobs(self) -> DataFrame:
        number = F.floor(F.col("event_id") / 7)
        state = (F.when(number % 11 == 3, "cancel_requested").when(number % 13 == 5, "failed")
                 .when(number % 2 == 0, "queued").otherwise("running"))
        return self.raw("events").groupBy(F.concat(F.lit("j"), number.cast("string")).alias("job_id"), state.alias("state")
                                          ).agg(F.min("ts").alias("created_at")).withColumn("kind", F.lit("ingest"))

    @cached_property
    def usage(self) -> DataFrame:
        t = F.col("event_type")
        kind = (F.when(t.isin("view", "error"), "query_text_tokens").when(t == "click", "query_media_tokens")
                .when(t == "purchase", "index_text_tokens").otherwise("index_media_tokens"))
        return self.raw("events").select(
            F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"), kind.alias("kind"),
            F.floor(F.col("value") * 100).cast("long").alias("quantity"),
            F.concat_ws(":", kind, F.col("user_id").cast("string"), F.floor(F.col("event_id") / 50).cast("string"))
            .alias("idem_key"), F.col("ts").alias("created_at"))

    @cached_property
    def workspaces(self) -> DataFrame:
        limits = [("w0", False, (2_000_000, 60_000, 9_000_000, 2)), ("w1", True, (1_000, 1_000, 1_000, 1)),
                  ("w2", False, (900_000_000, 30_000_000, 1_000, None))]
        return self.spark.createDataFrame(
            [(w, ("plan " + w, excess, row, {})) for w, excess, row in limits],
            f"workspace_id string, plan struct<name:string,allow_excess:boolean,limits:{LIMITS.simpleString()},"
            "features:map<string,boolean>>")

    @cached_property
    def queries(self) -> DataFrame:
        """Questions that grow with the table: every embedding whose id is divisible by 100 asks with its vector and, where
        there is one, with the words of its document."""
        e = self.raw("embeddings").where("vec_id % 100 = 0")
        asked = e.join(self.raw("documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
        return asked.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding", "text",
                            F.col("label").alias("query_label"))

    @cached_property
    def postings(self) -> DataFrame:
        """The stored term index of the passages of profile p1."""
        size = text_bytes(self.passages)
        index = open_term_index(self.spark, buckets=buckets_for(size))
        index.add(self.passages, size)
        return index.postings()

    @cached_property
    def word_queries(self) -> DataFrame:
        """Questions for the keyword side: every document asks with its own text."""
        return self.raw("documents").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), "text")

    @cached_property
    def transcript(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("line_no"),
                        (F.col("turn") * 3).cast("double").alias("start"), (F.col("turn") * 3 + 2.5).cast("double").alias("end"),
                        "text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, 0.8).otherwise(0.1).alias("no_speech_prob"))


def _views_sql() -> str:
    def text(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    def array(vs):
        return "NULL" if vs is None else "[" + ", ".join(text(v) for v in vs) + "]"
    rows = [f"({text(s)}, {array(p)}::VARCHAR[], {text(k)}, {text(None if k is None else literal(v))}, {text(x)}, "
            f"{array(m)}::VARCHAR[], {d}, {str(g).lower()})" for s, p, k, v, x, m, d, g in VIEWS]
    return "SELECT * FROM (VALUES " + ",\n".join(rows) + ") t(store_id, parents, mkey, mval, prefix, kinds, depth, gone)"


SQL_TABLES = f"""
docs AS (
  SELECT *, 'f' || doc_id AS file_id, source || '/' || doc_id || '/' || filename AS path,
         CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS last_no,
         'w' || (CAST(substr(source, 4) AS INTEGER) % 3) AS workspace_id,
         TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS created_at
  FROM (SELECT *, lang || ext AS filename FROM (SELECT *, CASE WHEN n_chars % 10 <= 4 THEN '.txt' WHEN n_chars % 10 = 5
        THEN '.md' WHEN n_chars % 10 = 6 THEN '.pdf' WHEN n_chars % 10 = 7 THEN '.png' WHEN n_chars % 10 = 8 THEN '.mp3'
        ELSE '.mp4' END AS ext FROM documents))),
files AS (
  SELECT workspace_id, file_id, path, CASE WHEN d.doc_id % 23 <> 7 THEN 'v' || d.doc_id || '-' || last_no END
         AS current_version_id, '"' || lang || '"' AS m_lang, '"' || source || '"' AS m_source,
         CAST(quality AS VARCHAR) AS m_quality, CAST(toxic AS VARCHAR) AS m_toxic, created_at, created_at AS updated_at,
         CASE WHEN d.doc_id % 17 = 3 THEN created_at + INTERVAL 5 DAY END AS deleted_at, d.doc_id
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id),
versions AS (
  SELECT workspace_id, 'v' || doc_id || '-' || version_no AS version_id, file_id, version_no,
         sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size, filename,
         CASE ext WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.pdf' THEN 'application/pdf'
              WHEN '.png' THEN 'image/png' WHEN '.mp3' THEN 'audio/mpeg' ELSE 'video/mp4' END AS media_type,
         created_at + to_days(CAST(version_no * 2 - 2 AS INTEGER)) AS created_at, doc_id
  FROM (SELECT *, CASE WHEN version_no = 1 THEN text ELSE text || chr(10) || 'revised' END AS body
        FROM (SELECT *, CAST(unnest(range(1, last_no + 1)) AS INTEGER) AS version_no FROM docs))),
segments AS (
  SELECT workspace_id, 's' || substr(profile_id, 2, 1) || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS segment_id,
         'v' || doc_id || '-' || last_no AS version_id, profile_id, 0 AS ordinal, modality,
         CASE WHEN modality = 'text' THEN 0 END AS loc_start,
         CASE WHEN modality = 'text' THEN CAST(n_chars AS INTEGER) END AS loc_end,
         CASE WHEN doc_id % 4 = 1 AND modality NOT IN ('audio', 'video') THEN CAST(doc_id % 9 + 1 AS INTEGER) END AS page,
         CASE WHEN modality = 'text' AND doc_id % 3 = 0 THEN 'Part ' || lang END AS section,
         CASE WHEN modality IN ('audio', 'video') THEN 0.0::DOUBLE END AS start_seconds,
         CASE WHEN modality IN ('audio', 'video') THEN CAST(n_chars % 60 AS DOUBLE) END AS end_seconds,
         CASE WHEN modality = 'text' THEN text END AS content, CAST(n_chars // 4 AS INTEGER) AS token_count,
         CAST(embedding AS DOUBLE[]) AS embedding, label, doc_id
  FROM (SELECT *, unnest(CASE WHEN doc_id % 3 = 0 THEN ['p1', 'p2'] ELSE ['p1'] END) AS profile_id
        FROM (SELECT d.*, e.embedding, e.label, CASE WHEN label IS NULL OR label <= 5 THEN 'text' WHEN label <= 7 THEN 'image'
                     WHEN label = 8 THEN 'audio' ELSE 'video' END AS modality
              FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id))),
p1 AS (SELECT * FROM segments WHERE profile_id = 'p1'),
views AS ({_views_sql()}),
stores AS (
  SELECT source AS store_id, 'Store ' || source AS name, 'material' AS kind,
         CASE WHEN source = 'src19' THEN TIMESTAMP '2024-01-10' END AS deleted_at FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT 'snap', 'Snapshot', 'snapshot', NULL
  UNION ALL SELECT store_id, 'View ' || store_id, 'view', CASE WHEN gone THEN TIMESTAMP '2024-01-11' END FROM views),
store_files AS (
  SELECT source AS store_id, file_id, CAST(NULL AS VARCHAR) AS pinned_version_id FROM docs
  UNION ALL SELECT 'src' || ((CAST(substr(source, 4) AS INTEGER) + 1) % 20), file_id, NULL FROM docs WHERE doc_id % 11 = 0
  UNION ALL SELECT 'snap', file_id, 'v' || doc_id || '-1' FROM docs WHERE doc_id % 9 = 0),
revisions AS (
  SELECT 'r1-' || store_id AS revision_id, store_id, 'p1' AS profile_id, 'active' AS state FROM stores
  UNION ALL SELECT 'r2-' || store_id, store_id, 'p2', CASE WHEN length(store_id) % 2 = 0 THEN 'ready' ELSE 'building' END
  FROM stores),
direct AS (
  SELECT sf.store_id, f.file_id, coalesce(sf.pinned_version_id, f.current_version_id) AS version_id, f.path, f.m_lang,
         f.m_source, f.m_quality, f.m_toxic, v.media_type, v.version_no, v.sha256
  FROM store_files sf JOIN files f ON f.file_id = sf.file_id AND f.deleted_at IS NULL
  JOIN stores s ON s.store_id = sf.store_id AND s.deleted_at IS NULL
  JOIN versions v ON v.version_id = coalesce(sf.pinned_version_id, f.current_version_id)),
level1 AS (
  SELECT w.store_id, d.* EXCLUDE (store_id) FROM (SELECT *, unnest(parents) AS parent FROM views WHERE depth = 1 AND NOT gone) w
  JOIN direct d ON d.store_id = w.parent
  WHERE (mkey IS NULL OR (mkey = 'lang' AND m_lang = mval) OR (mkey = 'quality' AND m_quality = mval))
    AND (prefix IS NULL OR starts_with(path, prefix)) AND (kinds IS NULL OR list_contains(kinds, media_type))
  QUALIFY row_number() OVER (PARTITION BY w.store_id, file_id ORDER BY version_no DESC NULLS LAST, version_id) = 1),
upto1 AS (SELECT * FROM direct UNION ALL SELECT * FROM level1),
level2 AS (
  SELECT w.store_id, d.* EXCLUDE (store_id) FROM (SELECT *, unnest(parents) AS parent FROM views WHERE depth = 2 AND NOT gone) w
  JOIN upto1 d ON d.store_id = w.parent
  WHERE (mkey IS NULL OR (mkey = 'lang' AND m_lang = mval) OR (mkey = 'quality' AND m_quality = mval))
    AND (prefix IS NULL OR starts_with(path, prefix)) AND (kinds IS NULL OR list_contains(kinds, media_type))
  QUALIFY row_number() OVER (PARTITION BY w.store_id, file_id ORDER BY version_no DESC NULLS LAST, version_id) = 1),
upto2 AS (SELECT * FROM upto1 UNION ALL SELECT * FROM level2),
level3 AS (
  SELECT w.store_id, d.* EXCLUDE (store_id) FROM (SELECT *, unnest(parents) AS parent FROM views WHERE depth = 3 AND NOT gone) w
  JOIN upto2 d ON d.store_id = w.parent
  WHERE (mkey IS NULL OR (mkey = 'lang' AND m_lang = mval) OR (mkey = 'quality' AND m_quality = mval))
    AND (prefix IS NULL OR starts_with(path, prefix)) AND (kinds IS NULL OR list_contains(kinds, media_type))
  QUALIFY row_number() OVER (PARTITION BY w.store_id, file_id ORDER BY version_no DESC NULLS LAST, version_id) = 1),
members AS (SELECT * FROM upto2 UNION ALL SELECT * FROM level3),
blobs AS (SELECT workspace_id, sha256, min(size) AS size, min(created_at) AS created_at FROM versions GROUP BY ALL),
items AS (
  SELECT 'i' || event_id AS item_id, 'j' || (event_id // 7) AS job_id, 'f' || user_id AS file_id,
         'v' || user_id || '-1' AS version_id, 'up/' || event_id || '.txt' AS path,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'cancelled'
              WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'queued'
              WHEN event_type = 'click' AND event_id % 9 = 0 THEN 'running' ELSE 'succeeded' END AS state,
         event_type = 'error' AND event_id % 2 = 0 AS retryable,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'SERVICE_UNAVAILABLE'
              WHEN event_type = 'error' THEN 'UNREADABLE' END AS error_code, ts AS updated_at FROM events),
jobs AS (
  SELECT 'j' || (event_id // 7) AS job_id, CASE WHEN (event_id // 7) % 11 = 3 THEN 'cancel_requested'
         WHEN (event_id // 7) % 13 = 5 THEN 'failed' WHEN (event_id // 7) % 2 = 0 THEN 'queued' ELSE 'running' END AS state,
         min(ts) AS created_at, 'ingest' AS kind FROM events GROUP BY ALL),
usage AS (
  SELECT workspace_id, kind, quantity, kind || ':' || user_id || ':' || (event_id // 50) AS idem_key, created_at FROM (
    SELECT *, 'w' || (user_id % 3) AS workspace_id, CASE WHEN event_type IN ('view', 'error') THEN 'query_text_tokens'
         WHEN event_type = 'click' THEN 'query_media_tokens' WHEN event_type = 'purchase' THEN 'index_text_tokens'
         ELSE 'index_media_tokens' END AS kind, CAST(floor(value * 100) AS BIGINT) AS quantity, ts AS created_at FROM events)),
workspaces AS (SELECT * FROM (VALUES ('w0', false, 2000000, 60000, 9000000, 2), ('w1', true, 1000, 1000, 1000, 1),
  ('w2', false, 900000000, 30000000, 1000, NULL)) t(workspace_id, allow_excess, storage_bytes, index_tokens_month,
  query_tokens_month, requests_per_minute)),
stop_words AS (SELECT unnest([{", ".join("'" + w + "'" for w in STOP_WORDS)}]) AS term),
documents_ids AS (
  SELECT *, list_filter(found, lambda t, i: list_position(found, t) = i)[1:12] AS ids FROM (
    SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z0-9][\\w.\\-/]*'),
           lambda t: regexp_matches(t, '[0-9]') OR regexp_matches(t, '^[A-Z]{{2,}}[\\w\\-]*$')) AS found FROM documents)),
queries AS (
  SELECT 'q' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding, text, label AS query_label
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
word_queries AS (SELECT 'q' || doc_id AS query_id, text, ids FROM documents_ids WHERE len(ids) > 0),
words AS (
  SELECT segment_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM (
    SELECT segment_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS terms FROM p1 WHERE content IS NOT NULL)),
postings AS (SELECT segment_id, term, pos FROM words WHERE term NOT IN (SELECT term FROM stop_words)),
eligible AS (SELECT count(*) AS n FROM p1 WHERE content IS NOT NULL),
transcript AS (
  SELECT conv_id AS media_id, CAST(turn AS INTEGER) AS line_no, CAST(turn * 3 AS DOUBLE) AS "start",
         CAST(turn * 3 + 2.5 AS DOUBLE) AS "end", text, CASE WHEN (conv_id + turn) % 7 = 0 THEN 0.8 ELSE 0.1 END
         AS no_speech_prob FROM conversations)"""
