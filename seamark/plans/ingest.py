"""Queries of the source checks."""

from pyspark.sql import functions as F

from seamark.operators.ingest_plan import plan_ingest
from seamark.operators.metering import USAGE_KINDS, dedup_usage, month_totals, quota_report
from seamark.plans.bindings import ntz
from seamark.plans.embedding import preparations
from seamark.plans.registry import query
from seamark.sources.export import export_segments
from seamark.sources.files import dedup_blobs, gated, verify_checksums
from seamark.sources.manifest import mirror_manifest
from seamark.sources.uploads import completeness, missing_parts, validate_manifest
from seamark.operators.prepare import decode_text
from seamark.functions.vectors import decode_vector, encode_vector

_REASON_SQL = """
CASE WHEN length(path) < 1 OR length(path) > 1024 OR contains(path, chr(92)) OR regexp_matches(path, '[\\x00-\\x1f\\x7f]')
          OR regexp_matches(path, '^[A-Za-z]:') OR list_has_any(string_split(path, '/'), ['', '.', '..']) THEN 'unsafe path'
     WHEN len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) > 0 THEN 'hidden'
     WHEN regexp_extract(lower(path), '\\.[^./]+$') NOT IN ('.txt', '.md', '.markdown', '.pdf', '.docx', '.jpg', '.jpeg', '.png',
          '.wav', '.mp3', '.mp4') THEN 'unsupported format'
     WHEN size = 0 THEN 'empty file' WHEN size > 536870912 THEN 'too large' END"""


def _listing(t):
    """Paths of all pages (as a crawler would name them) and of all documents, some of them unusable."""
    url = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 5
    suffix = F.when(kind == 0, ".md").when(kind == 1, ".html").when(kind == 2, ".TXT").when(kind == 3, "/../x.txt").otherwise(
        ".pdf")
    pages = t.raw("pages").select(F.concat(F.regexp_replace(url, "[?#].*$", ""), suffix).alias("path"),
                                  F.octet_length("html").cast("long").alias("size"))
    n = F.col("doc_id") % 8
    prefix = F.when(n == 0, "/").when(n == 1, "C:").when(n == 2, "a\\").when(n == 3, ".git/").when(
        n == 4, "café/").otherwise("")
    docs = t.docs.select(F.concat(prefix, F.col("path")).alias("path"),
                         F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 7 == 1, 600_000_000)
                         .otherwise(F.col("n_chars")).cast("long").alias("size"))
    return pages.unionByName(docs)


@query("gate_paths", f"""
WITH listing AS (
  SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.md'
         WHEN 1 THEN '.html' WHEN 2 THEN '.TXT' WHEN 3 THEN '/../x.txt' ELSE '.pdf' END AS path,
         CAST(strlen(html) AS BIGINT) AS size FROM pages
  UNION ALL SELECT nfc_normalize(CASE doc_id % 8 WHEN 0 THEN '/' WHEN 1 THEN 'C:' WHEN 2 THEN 'a' || chr(92) WHEN 3 THEN '.git/'
         WHEN 4 THEN 'cafe' || chr(769) || '/' ELSE '' END || path),
         CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 600000000 ELSE n_chars END FROM docs)
SELECT path, size, {_REASON_SQL} AS reason FROM listing""")
def gate_paths(t):
    return gated(_listing(t)).select("path", "size", "reason")


def _manifest(t):
    """Orders as manifest entries: a customer's orders of one priority form a session; some paths repeat."""
    number = F.col("o_orderkey") % 50
    ext = F.when(F.col("o_orderstatus") == "P", ".zip").otherwise(".txt")
    return t.raw("orders").select(
        F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string")).alias("workspace_id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("session_id"),
        F.concat(F.lit("in/"), number.cast("string"), ext).alias("path"),
        F.floor(F.col("o_totalprice") * 1200).cast("long").alias("size"))


@query("validate_manifest", """
WITH m AS (SELECT 'w' || (o_custkey % 3) AS workspace_id, o_custkey || '-' || o_orderpriority AS session_id,
  'in/' || (o_orderkey % 50) || CASE WHEN o_orderstatus = 'P' THEN '.zip' ELSE '.txt' END AS path,
  CAST(floor(o_totalprice * 1200) AS BIGINT) AS size FROM orders),
p AS (SELECT workspace_id, session_id, path, count(*) AS n, sum(size) AS bytes, count(*) FILTER (size > 536870912) AS oversize
      FROM m GROUP BY ALL),
s AS (SELECT workspace_id, session_id, CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (n > 1) AS duplicate_paths,
  CAST(sum(oversize) AS BIGINT) AS oversize_files, count(*) FILTER (path LIKE '%.zip') AS unsupported_files,
  CAST(sum(bytes) AS BIGINT) AS total_bytes FROM p GROUP BY ALL)
SELECT session_id, files, duplicate_paths, oversize_files, unsupported_files, total_bytes,
  CASE WHEN files > 1000 THEN 'INPUT_TOO_LARGE' WHEN duplicate_paths > 0 THEN 'INVALID_REQUEST'
       WHEN oversize_files > 0 THEN 'INPUT_TOO_LARGE' WHEN unsupported_files > 0 THEN 'FORMAT_UNSUPPORTED'
       WHEN NOT allow_excess AND total_bytes > storage_bytes THEN 'QUOTA_EXCEEDED' ELSE 'ACCEPTED' END AS verdict
FROM s LEFT JOIN workspaces USING (workspace_id)""")
def validate_manifest_query(t):
    quotas = t.workspaces.select("workspace_id", F.when(~F.col("plan.allow_excess"), F.col("plan.limits.storage_bytes"))
                                 .alias("remaining_bytes"))
    return validate_manifest(_manifest(t), quotas).select("session_id", "files", "duplicate_paths", "oversize_files",
                                                          "unsupported_files", "total_bytes", "verdict")


def _uploads(t):
    n = F.col("o_orderkey") % 7 + 1
    files = t.raw("orders").select(F.col("o_orderkey").alias("file_id"), (n * 100 - 30).alias("size"),
                                   F.lit(100).cast("long").alias("part_size"))
    line = t.raw("lineitem")
    size = F.when(F.col("l_linenumber") == F.col("l_orderkey") % 7 + 1, F.when(F.col("l_returnflag") == "A", 70).otherwise(
        60)).otherwise(100).cast("long")
    parts = line.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("part_no"), size.alias("size"))
    return files, parts


_UPLOADS_SQL = """
up AS (SELECT o_orderkey AS file_id, o_orderkey % 7 + 1 AS n FROM orders),
got AS (SELECT l_orderkey AS file_id, l_linenumber AS part_no, max(CASE WHEN l_linenumber = l_orderkey % 7 + 1
  THEN CASE WHEN l_returnflag = 'A' THEN 70 ELSE 60 END ELSE 100 END) AS size FROM lineitem GROUP BY ALL)"""


@query("missing_parts", f"""
WITH {_UPLOADS_SQL},
want AS (SELECT file_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS part_no, n FROM up)
SELECT w.file_id, w.part_no, CASE WHEN g.size IS NULL THEN 'missing' ELSE 'wrong size' END AS problem
FROM want w LEFT JOIN got g ON g.file_id = w.file_id AND g.part_no = w.part_no
WHERE g.size IS NULL OR g.size <> CASE WHEN w.part_no < n THEN 100 ELSE 70 END""")
def missing_parts_query(t):
    files, parts = _uploads(t)
    return missing_parts(files, parts).select("file_id", "part_no", "problem")


@query("upload_completeness", f"""
WITH {_UPLOADS_SQL}
SELECT up.file_id, CAST(n AS BIGINT) AS expected, coalesce(r, 0) AS received, n = coalesce(r, 0) AS complete
FROM up LEFT JOIN (SELECT file_id, count(*) AS r FROM got GROUP BY ALL) g USING (file_id)""")
def upload_completeness(t):
    files, parts = _uploads(t)
    return completeness(files, parts).select("file_id", "expected", "received", "complete")


@query("verify_checksums", """
SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN 'UPLOAD_MISSING' WHEN doc_id % 13 = 6 THEN 'CHECKSUM_MISMATCH' ELSE 'VERIFIED' END
  AS outcome, sha256(text) AS sha256 FROM documents""")
def verify_checksums_query(t):
    d = t.raw("documents")
    manifest = d.select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("long").alias("size"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    damaged = F.when(F.col("doc_id") % 13 == 6, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    received = d.where("doc_id % 13 <> 5").select(F.col("doc_id").alias("file_id"), damaged.cast("binary").alias("content"))
    return verify_checksums(received, manifest).select(F.col("file_id").alias("doc_id"), "outcome", "sha256")


@query("dedup_blobs", """
SELECT workspace_id, sha256, min(size) AS size, min(version_id) AS first_version_id, count(*) AS refs,
  CAST((count(*) - 1) * min(size) AS BIGINT) AS saved_bytes FROM versions GROUP BY workspace_id, sha256""")
def dedup_blobs_query(t):
    return dedup_blobs(t.versions).select("workspace_id", "sha256", "size", "first_version_id", "refs", "saved_bytes")


@query("mirror_manifest", """
WITH cur AS (SELECT f.path, f.file_id, v.sha256, f.doc_id FROM files f JOIN versions v ON v.version_id = f.current_version_id
             WHERE f.deleted_at IS NULL),
man AS (SELECT CASE WHEN doc_id % 10 = 9 THEN '../' || path ELSE path END AS path,
               CASE WHEN doc_id % 10 = 1 THEN sha256('new ' || path) ELSE sha256 END AS sha
        FROM (SELECT f.doc_id, f.path, v.sha256 FROM files f JOIN versions v ON v.file_id = f.file_id
              AND v.version_no = CASE WHEN f.doc_id % 5 = 0 THEN 2 ELSE 1 END) WHERE doc_id % 10 <> 2)
SELECT coalesce(c.path, m.path) AS path, file_id,
  CASE WHEN m.path IS NULL AND c.doc_id % 4 = 0 THEN 'removed' WHEN m.path IS NULL THEN 'kept' WHEN c.path IS NULL THEN 'new'
       WHEN c.sha256 = m.sha THEN 'unchanged' ELSE 'changed' END AS action
FROM cur c FULL JOIN (SELECT * FROM man WHERE path NOT LIKE '../%') m ON m.path = c.path
UNION ALL SELECT path, NULL, 'skipped' FROM man WHERE path LIKE '../%'""")
def mirror_manifest_query(t):
    tagged = F.when(F.col("doc_id") % 4 == 0, F.map_concat("metadata", F.create_map(F.lit("connector_id"), F.lit('"c1"')))
                    ).otherwise(F.col("metadata"))
    current = t.versions.select(F.col("version_id").alias("current_version_id"), "sha256")
    members = t.files.where("deleted_at is null").join(current, "current_version_id").select(
        "file_id", "path", "sha256", tagged.alias("metadata"))
    latest = t.versions.groupBy("file_id").agg(F.max_by("sha256", "version_no").alias("sha256"))
    n = F.col("doc_id") % 10
    manifest = t.files.join(latest, "file_id").where(n != 2).select(
        F.when(n == 9, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(n == 1, F.sha2(F.concat(F.lit("new "), "path").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return mirror_manifest(manifest, members, "c1").select("path", "file_id", "action")


@query("export_segments", """
SELECT m.store_id, s.segment_id, s.modality, s.token_count, m.file_id, s.version_id, v.version_no, m.path, v.filename,
  v.media_type, v.sha256, s.page, s.content
FROM members m JOIN p1 s ON s.version_id = m.version_id JOIN versions v ON v.version_id = s.version_id""")
def export_segments_query(t):
    rows = export_segments(t.members, t.p1, t.files, t.versions, ["content"])
    names = ["file_id", "version_id", "version_no", "path", "filename", "media_type", "sha256"]
    return rows.select("store_id", "segment_id", "modality", "token_count", *[F.col("source")[n].alias(n) for n in names],
                       F.col("source.location.page").alias("page"), "content")


@query("encode_vectors", "SELECT vec_id, true AS same, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def encode_vectors(t):
    coded = t.raw("embeddings").withColumn("code", encode_vector("embedding"))
    back = coded.withColumn("back", decode_vector("code"))
    return back.select("vec_id", (F.col("back") == F.col("embedding")).alias("same"), F.size("back").alias("n"))


@query("decode_text", """
SELECT doc_id, CASE WHEN doc_id % 19 = 1 OR doc_id % 19 = 2 THEN 'UNREADABLE' WHEN doc_id % 19 = 3 OR trim(text) = ''
  THEN 'EMPTY_CONTENT' END AS error_code,
  CASE WHEN doc_id % 19 IN (1, 2, 3) OR trim(text) = '' THEN NULL ELSE sha256(text) END AS text_sha FROM documents""")
def decode_text_query(t):
    n = F.col("doc_id") % 19
    body = F.col("text").cast("binary")
    raw = (F.when(n == 1, F.concat(body, F.unhex(F.lit("FF")))).when(n == 2, F.concat(body, F.unhex(F.lit("00"))))
           .when(n == 3, F.encode(F.lit(" \n\t "), "UTF-8")).when(n == 4, F.concat(F.unhex(F.lit("EFBBBF")), body)).otherwise(body))
    decoded = decode_text(t.raw("documents").select("doc_id", raw.alias("content")))
    return decoded.select("doc_id", "error_code", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


@query("ingest_plan", """
WITH once AS (SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY workspace_id, idem_key ORDER BY created_at, kind, quantity) = 1),
tot AS (SELECT workspace_id, sum(quantity) AS i FROM once WHERE kind LIKE 'index%' AND date_trunc('month', created_at) = TIMESTAMP '2024-01-01' GROUP BY ALL),
refused AS (SELECT w.workspace_id, NOT allow_excess AND coalesce(i, 0) >= index_tokens_month AS index_refused FROM workspaces w LEFT JOIN tot USING (workspace_id)),
base AS (SELECT d.doc_id, d.workspace_id, d.source AS store_id, CASE WHEN d.doc_id % 6 = 3 THEN 'new/' || d.doc_id || d.ext ELSE d.path END AS path,
    CASE WHEN d.doc_id % 2 = 0 THEN lv.sha256 ELSE sha256('other ' || d.doc_id) END AS sha256, d.created_at AS modified_at, d.last_no, lv.media_type,
    f.file_id, f.deleted_at IS NULL AND d.doc_id % 6 <> 3 AS there, f.current_version_id, cv.sha256 AS current_sha
  FROM docs d JOIN files f USING (file_id) JOIN versions lv ON lv.file_id = d.file_id AND lv.version_no = d.last_no
  LEFT JOIN versions cv ON cv.version_id = f.current_version_id),
del AS (SELECT 'a' || doc_id AS item_id, * FROM base UNION ALL SELECT 'b' || doc_id, * FROM base WHERE doc_id % 4 = 1
  UNION ALL SELECT 'c' || doc_id, * REPLACE (sha256('older ' || doc_id) AS sha256, modified_at - INTERVAL 1 HOUR AS modified_at) FROM base WHERE doc_id % 4 = 3),
folded AS (SELECT *, CASE WHEN doc_id % 13 = 5 THEN 'rejected' WHEN doc_id % 7 = 2 THEN 'superseded' WHEN row_number() OVER w = 1 THEN 'publish'
    WHEN sha256 = first_value(sha256) OVER w THEN 'repeated' ELSE 'superseded' END AS fold
  FROM del WINDOW w AS (PARTITION BY store_id, path ORDER BY modified_at DESC, sha256 DESC, item_id DESC)),
act AS (SELECT *, regexp_extract(path, '[^/]+$') AS filename, CASE WHEN fold <> 'publish' THEN fold WHEN NOT there THEN 'new_file'
    WHEN current_sha = sha256 THEN 'reuse' ELSE 'new_version' END AS action FROM folded),
reached AS (SELECT store_id, store_id AS idx FROM stores WHERE deleted_at IS NULL UNION ALL
  SELECT parent, store_id FROM (SELECT store_id, unnest(parents) AS parent FROM views WHERE NOT gone)),
wanted AS (SELECT DISTINCT x.store_id, r.profile_id FROM reached x JOIN revisions r ON r.store_id = x.idx),
need AS (SELECT DISTINCT a.item_id, w.profile_id FROM act a JOIN wanted w ON w.store_id = a.store_id OR (a.there AND w.store_id IN
  (SELECT sf.store_id FROM store_files sf WHERE sf.file_id = a.file_id)) WHERE a.fold = 'publish'),
have AS (SELECT DISTINCT version_id, profile_id FROM segments),
work AS (SELECT item_id, a.action, n.profile_id, EXISTS (SELECT 1 FROM versions v JOIN have h USING (version_id) WHERE v.sha256 = a.sha256
      AND v.filename = a.filename AND h.profile_id = n.profile_id) OR (a.action = 'reuse' AND a.media_type IN ('image/png', 'video/mp4') AND EXISTS
      (SELECT 1 FROM have h WHERE h.version_id = a.current_version_id)) AS copied
  FROM act a JOIN need n USING (item_id) WHERE NOT (a.action = 'reuse' AND EXISTS (SELECT 1 FROM have h WHERE h.version_id = a.current_version_id
      AND h.profile_id = n.profile_id))),
sums AS (SELECT item_id, count(*) FILTER (copied) AS copies, count(*) FILTER (NOT copied) AS embeds FROM work GROUP BY item_id),
r AS (SELECT a.*, coalesce(copies, 0) AS copies, coalesce(embeds, 0) AS embeds, coalesce(embeds, 0) > 0 AND index_refused AS over
  FROM act a LEFT JOIN sums USING (item_id) LEFT JOIN refused USING (workspace_id))
SELECT item_id, path, action, CASE WHEN action IN ('reuse', 'new_version') THEN file_id END AS known_file,
  CASE WHEN action = 'reuse' THEN current_version_id END AS known_version,
  CAST(CASE action WHEN 'new_file' THEN 1 WHEN 'new_version' THEN last_no + 1 END AS INTEGER) AS version_no, copies, embeds,
  CASE WHEN action = 'rejected' OR over THEN 'failed' WHEN embeds > 0 THEN 'queued' ELSE 'succeeded' END AS state, over AS retryable,
  CASE WHEN action = 'rejected' THEN 'empty file' WHEN over THEN 'QUOTA_EXCEEDED' END AS error_code FROM r""")
def ingest_plan_query(t):
    """Every document is delivered: some twice, some after an older revision or after a newer one was published, some empty,
    some at a new path."""
    doc, n = F.col("doc_id").cast("string"), F.col("doc_id")
    latest = t.versions.groupBy("file_id").agg(F.max_by("sha256", "version_no").alias("latest_sha"))
    base = t.docs.join(latest, "file_id").select(
        "doc_id", "workspace_id", F.col("source").alias("store_id"),
        F.when(n % 6 == 3, F.concat(F.lit("new/"), doc, "ext")).otherwise(F.col("path")).alias("path"),
        F.when(n % 2 == 0, F.col("latest_sha")).otherwise(F.sha2(F.concat(F.lit("other "), doc).cast("binary"), 256)).alias("sha256"),
        F.col("created_at").alias("modified_at"), F.when(n % 13 == 5, 0).otherwise(1).cast("bigint").alias("size"))
    item = lambda letter: F.concat(F.lit(letter), doc).alias("item_id")
    older = base.where(n % 4 == 3).withColumn("sha256", F.sha2(F.concat(F.lit("older "), doc).cast("binary"), 256)).withColumn(
        "modified_at", F.col("modified_at") - F.expr("interval 1 hour"))
    arrived = gated(base.select(item("a"), "*").unionByName(base.where(n % 4 == 1).select(item("b"), "*")).unionByName(older.select(item("c"), "*")))
    seen = base.where(n % 7 == 2).select("workspace_id", "store_id", "path", (F.col("modified_at") + F.expr("interval 1 day")).alias("modified_at"))
    totals = month_totals(dedup_usage(t.usage), USAGE_KINDS).where(F.col("month") == ntz("2024-01-01 00:00:00"))
    storage = t.workspaces.select("workspace_id", F.lit(0).cast("bigint").alias("total_bytes"))
    refused = quota_report(storage, totals, t.workspaces).select("workspace_id", F.array_contains("refused", "indexing").alias("index_refused"))
    plan = plan_ingest(arrived.drop("doc_id", "modality"), seen, t.files, t.versions, t.store_files, t.stores, t.revisions, t.segments,
                       preparations(t), refused)
    known = F.col("action").isin("reuse", "new_version")
    return plan.select("item_id", "path", "action", F.when(known, F.col("file_id")).alias("known_file"),
                       F.when(F.col("action") == "reuse", F.col("version_id")).alias("known_version"), "version_no", "copies", "embeds", "state",
                       "retryable", "error_code")
