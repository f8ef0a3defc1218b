"""Queries of versions, publication, deletion, retention, paging."""

from pyspark.sql import functions as F

from seamark.operators.lifecycle import (check_replay, delete_files, delete_store, patch_metadata, promotable, promote,
                                         publish, reindex_plan, replay_ledger, resolve_versions, retry_plan,
                                         unshared_sources)
from seamark.operators.paging import audit_page, latest_by, page, segments_page
from seamark.operators.retention import collect_blobs, collect_versions, expired_assets, expired_sessions
from seamark.operators.statistics import OPEN_STATES
from seamark.plans.bindings import CUTOFF, ntz
from seamark.plans.registry import query


@query("resolve_versions", """
WITH inc AS (SELECT f.*, f.doc_id % 6 AS kind, d.last_no, deleted_at IS NULL AS alive, CASE WHEN f.doc_id % 2 = 0 THEN lv.sha256
  ELSE sha256('other ' || f.doc_id) END AS sha, cv.sha256 AS current_sha
  FROM files f JOIN docs d USING (file_id) LEFT JOIN versions lv ON lv.file_id = f.file_id AND lv.version_no = d.last_no
  LEFT JOIN versions cv ON cv.version_id = f.current_version_id),
tgt AS (SELECT *, CASE WHEN kind = 0 THEN file_id WHEN kind <> 3 AND alive THEN file_id END AS target FROM inc),
act AS (SELECT *, CASE WHEN target IS NULL THEN 'new_file' WHEN NOT alive THEN 'NOT_FOUND' WHEN current_sha = sha THEN 'reuse'
  ELSE 'new_version' END AS action FROM tgt)
SELECT 'n' || doc_id AS item_id, target AS known_file, action, CAST(CASE action WHEN 'new_file' THEN 1 WHEN 'new_version' THEN last_no + 1 END
  AS INTEGER) AS version_no FROM act""")
def resolve_versions_query(t):
    latest = t.versions.groupBy("file_id").agg(F.max_by("sha256", "version_no").alias("latest_sha"))
    kind, doc = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    source = t.docs.select("file_id", "source")
    base = t.files.join(latest, "file_id").join(source, "file_id")
    sha = F.when(F.col("doc_id") % 2 == 0, F.col("latest_sha")).otherwise(F.sha2(F.concat(F.lit("other "), doc).cast("binary"), 256))
    incoming = base.select(
        F.concat(F.lit("n"), doc).alias("item_id"), F.col("source").alias("store_id"),
        F.when(kind == 0, F.col("file_id")).alias("file_id"), F.concat(F.lit("u"), doc).alias("upload_id"),
        F.when(kind == 3, F.concat(F.lit("new/"), doc)).otherwise(F.col("path")).alias("path"), sha.alias("sha256"),
        F.lit(1).cast("long").alias("size"), F.lit("text/plain").alias("media_type"))
    earlier = base.where(kind == 1).select(F.concat(F.lit("u"), doc).alias("upload_id"), "file_id")
    plan = resolve_versions(incoming, t.files, t.versions, t.store_files, earlier)
    known = t.files.select("file_id", F.col("file_id").alias("known_file"))
    return plan.join(known, "file_id", "left").select("item_id", "known_file", "action", "version_no")


@query("publish", """
SELECT file_id, CASE WHEN deleted_at IS NULL THEN coalesce(current_version_id, 'v' || doc_id || '-1') ELSE current_version_id END
  AS current_version_id FROM files""")
def publish_query(t):
    batch = t.versions.where("version_no = 1").select("file_id", "version_id")
    return publish(t.files, t.versions, batch).select("file_id", "current_version_id")


@query("patch_metadata", """
SELECT file_id, concat_ws(',', 'note="n"', 'quality=5', 'source=' || m_source, 'toxic=' || m_toxic) AS metadata,
  doc_id % 2 = 0 AS reprocessing_required, CAST(NULL AS VARCHAR) AS error_code FROM files""")
def patch_metadata_query(t):
    patch = F.create_map(F.lit("lang"), F.lit("null"), F.lit("quality"), F.lit("5"), F.lit("note"), F.lit('"n"'))
    patches = t.files.select("file_id", patch.alias("patch"))
    fields = t.files.select("file_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("lang"))).otherwise(
        F.array(F.lit("source"))).alias("fields"))
    rows = patch_metadata(t.files, patches, fields)
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("file_id", F.array_join(pairs, ",").alias("metadata"), "reprocessing_required", "error_code")


@query("reindex_plan", """
WITH todo AS (SELECT DISTINCT file_id, version_id FROM members WHERE store_id = 'src2' AND version_id NOT IN
  (SELECT version_id FROM segments WHERE profile_id = 'p2')),
have AS (SELECT DISTINCT sha256, filename FROM versions WHERE version_id IN (SELECT version_id FROM segments WHERE profile_id = 'p2'))
SELECT t.file_id, t.version_id, CASE WHEN h.sha256 IS NOT NULL THEN 'copy' ELSE 'embed' END AS action
FROM todo t JOIN versions v ON v.version_id = t.version_id LEFT JOIN have h ON h.sha256 = v.sha256 AND h.filename = v.filename""")
def reindex_plan_query(t):
    return reindex_plan(t.members.where("store_id = 'src2'"), t.segments, t.versions, "p2")


_PROMOTABLE = """
verdicts AS (SELECT revision_id, store_id, state, missing, CASE WHEN state = 'active' THEN 'active' WHEN state <> 'ready' THEN 'INDEX_NOT_READY'
  WHEN missing > 0 THEN 'INDEX_INCOMPLETE' ELSE 'promotable' END AS verdict FROM (
  SELECT r.revision_id, r.store_id, r.state, count(*) FILTER (m.version_id IS NOT NULL AND h.version_id IS NULL) AS missing
  FROM revisions r LEFT JOIN members m USING (store_id) LEFT JOIN (SELECT DISTINCT version_id, profile_id FROM segments) h
  ON h.version_id = m.version_id AND h.profile_id = r.profile_id GROUP BY ALL))"""


@query("promotable", f"WITH {_PROMOTABLE} SELECT * FROM verdicts")
def promotable_query(t):
    return promotable(t.revisions, t.members, t.segments)


_WANTED = ["r2-src1", "r2-src10", "r2-src4", "r2-src13", "r1-src2", "r2-v_gone"]  # refused, active and promoted ones


@query("promote", f"""WITH {_PROMOTABLE}, asked AS (SELECT * FROM verdicts WHERE revision_id IN ({", ".join(map(repr, _WANTED))})),
moved AS (SELECT store_id, revision_id AS fresh FROM asked WHERE verdict = 'promotable')
SELECT r.revision_id, CASE WHEN r.revision_id = m.fresh THEN 'active' WHEN m.fresh IS NOT NULL AND r.state = 'active' THEN 'ready'
  ELSE r.state END AS state, CASE WHEN a.verdict IN ('promotable', 'active') THEN 'active' ELSE a.verdict END AS outcome
FROM revisions r LEFT JOIN moved m USING (store_id) LEFT JOIN asked a USING (revision_id)""")
def promote_query(t):
    verdicts = promotable(t.revisions, t.members, t.segments)
    after, _, outcomes = promote(t.revisions, t.stores, verdicts, _WANTED)
    return after.select("revision_id", "state").join(outcomes, "revision_id", "left")


@query("unshared_sources", """
SELECT file_id, path FROM files WHERE deleted_at IS NULL AND file_id IN (SELECT file_id FROM store_files WHERE store_id = 'src3')
AND file_id NOT IN (SELECT file_id FROM store_files JOIN stores USING (store_id) WHERE deleted_at IS NULL AND store_id <> 'src3')""")
def unshared_sources_query(t):
    return unshared_sources(t.store_files, t.stores, t.files, "src3")


@query("delete_store", f"""
WITH lone AS (SELECT file_id FROM store_files WHERE store_id = 'src3' AND file_id NOT IN (SELECT file_id FROM store_files JOIN stores
  USING (store_id) WHERE deleted_at IS NULL AND store_id <> 'src3'))
SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM lone) THEN coalesce(deleted_at, TIMESTAMP '{CUTOFF}') ELSE deleted_at END AS deleted_at,
  (SELECT count(*) FROM store_files s WHERE s.file_id = f.file_id AND store_id <> 'src3') AS memberships FROM files f""")
def delete_store_query(t):
    after = delete_store(t.stores, t.store_files, t.files, t.revisions, "src3", ntz(CUTOFF), "unshared")
    left = after["store_files"].groupBy("file_id").agg(F.count(F.lit(1)).alias("memberships"))
    return after["files"].select("file_id", "deleted_at").join(left, "file_id", "left").withColumn(
        "memberships", F.coalesce("memberships", F.lit(0)))


@query("delete_files", f"""
SELECT file_id, CASE WHEN m_toxic = '1' THEN coalesce(deleted_at, TIMESTAMP '{CUTOFF}') ELSE deleted_at END AS deleted_at FROM files""")
def delete_files_query(t):
    toxic = t.files.where(F.try_element_at("metadata", F.lit("toxic")) == "1").select("file_id")
    return delete_files(t.files, toxic, ntz(CUTOFF)).select("file_id", "deleted_at")


_GC = f"""
gone AS (SELECT file_id FROM files WHERE deleted_at < TIMESTAMP '{CUTOFF}'),
needed AS (SELECT current_version_id AS version_id FROM files WHERE file_id NOT IN (SELECT file_id FROM gone) AND current_version_id IS NOT NULL
  UNION SELECT pinned_version_id FROM store_files WHERE file_id NOT IN (SELECT file_id FROM gone) AND pinned_version_id IS NOT NULL
  UNION SELECT version_id FROM items WHERE state IN ('queued', 'running')),
removed AS (SELECT version_id, 'source deleted' AS reason FROM versions WHERE file_id IN (SELECT file_id FROM gone)
  UNION ALL SELECT version_id, 'superseded' FROM versions WHERE created_at < TIMESTAMP '{CUTOFF}' AND file_id NOT IN (SELECT file_id FROM gone)
  AND version_id NOT IN (SELECT version_id FROM needed))"""


@query("gc_versions", f"WITH {_GC} SELECT version_id, reason FROM removed")
def gc_versions(t):
    return collect_versions(t.versions, t.files, t.store_files, t.items, ntz(CUTOFF)).select("version_id", "reason")


@query("gc_blobs", f"""WITH {_GC},
kept AS (SELECT workspace_id, sha256 FROM versions WHERE version_id NOT IN (SELECT version_id FROM removed)
  UNION SELECT workspace_id, sha256 FROM versions WHERE version_id IN (SELECT version_id FROM items WHERE state IN ('queued', 'running')))
SELECT workspace_id, sha256, size FROM blobs b WHERE created_at < TIMESTAMP '{CUTOFF}' AND NOT EXISTS (SELECT 1 FROM kept k
  WHERE k.workspace_id = b.workspace_id AND k.sha256 = b.sha256)""")
def gc_blobs(t):
    removed = collect_versions(t.versions, t.files, t.store_files, t.items, ntz(CUTOFF))
    waiting = t.items.where(F.col("state").isin(OPEN_STATES)).select("version_id")
    pending = t.versions.join(waiting, "version_id", "left_semi")
    return collect_blobs(t.blobs, t.versions, removed, pending, ntz(CUTOFF)).select("workspace_id", "sha256", "size")


def _ledger(t):
    kind = F.when(F.col("event_type") == "signup", "store.delete").otherwise("file.delete")
    user = F.col("user_id")
    store = F.concat(F.lit("src"), (user % 7 + 13).cast("string"))
    return t.raw("events").where(F.col("event_type").isin("signup", "purchase")).select(
        kind.alias("kind"), F.when(kind == "store.delete", store).otherwise(F.concat(F.lit("f"), user.cast("string"))).alias("id"),
        F.col("ts").alias("at"), F.when(kind == "store.delete", F.array(F.concat(F.lit("f"), (user + 500).cast("string")))).alias("file_ids"))


_LEDGER = """
led AS (SELECT CASE WHEN event_type = 'signup' THEN 'src' || (user_id % 7 + 13) END AS store_id, CASE WHEN event_type = 'signup' THEN
  'f' || (user_id + 500) ELSE 'f' || user_id END AS file_id, ts FROM events WHERE event_type IN ('signup', 'purchase')
  AND ts > TIMESTAMP '2024-01-15 00:00:00')"""


@query("replay_ledger", f"""WITH {_LEDGER}
SELECT f.file_id, coalesce(f.deleted_at, l.at) AS deleted_at FROM files f LEFT JOIN (SELECT file_id, min(ts) AS at FROM led GROUP BY ALL) l
  USING (file_id)""")
def replay_ledger_query(t):
    after = replay_ledger(t.files, t.stores, t.store_files, _ledger(t), ntz("2024-01-15 00:00:00"))
    return after["files"].select("file_id", "deleted_at")


@query("replay_ledger_stores", f"""WITH {_LEDGER}
SELECT s.store_id, coalesce(s.deleted_at, l.at) AS deleted_at, (SELECT count(*) FROM store_files x WHERE x.store_id = s.store_id AND x.store_id
  NOT IN (SELECT store_id FROM led WHERE store_id IS NOT NULL)) AS memberships
FROM stores s LEFT JOIN (SELECT store_id, min(ts) AS at FROM led WHERE store_id IS NOT NULL GROUP BY ALL) l USING (store_id)""")
def replay_ledger_stores(t):
    after = replay_ledger(t.files, t.stores, t.store_files, _ledger(t), ntz("2024-01-15 00:00:00"))
    left = after["store_files"].groupBy("store_id").agg(F.count(F.lit(1)).alias("memberships"))
    return after["stores"].select("store_id", "deleted_at").join(left, "store_id", "left").withColumn(
        "memberships", F.coalesce("memberships", F.lit(0)))


@query("retry_plan", """
SELECT i.job_id AS retry_of, i.item_id, i.path, i.file_id FROM items i JOIN jobs j USING (job_id)
WHERE j.state IN ('completed', 'completed_with_errors', 'failed', 'cancelled') AND i.state = 'failed' AND i.retryable""")
def retry_plan_query(t):
    return retry_plan(t.jobs, t.items).select("retry_of", "item_id", "path", "file_id")


@query("idempotency_conflicts", """
WITH r AS (SELECT user_id || '-' || (event_id // 500) AS idem_key, ts, event_id, event_type FROM events),
f AS (SELECT idem_key, arg_min(event_id, (ts, event_id)) AS request_id, arg_min(event_type, (ts, event_id)) AS body FROM r GROUP BY idem_key)
SELECT r.idem_key, f.request_id, count(*) FILTER (r.event_type = f.body) - 1 AS replayed, count(*) FILTER (r.event_type <> f.body) AS conflicts
FROM r JOIN f USING (idem_key) GROUP BY ALL""")
def idempotency_conflicts(t):
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 500).cast("string"))
    requests = t.raw("events").select(key.alias("idem_key"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"), "event_type")
    return check_replay(requests, ["event_type"])


@query("keyset_page", """
SELECT file_id, path, created_at FROM files WHERE (created_at, file_id) < (TIMESTAMP '2024-01-01 02:30:00', 'f150')
ORDER BY created_at DESC, file_id DESC LIMIT 51""")
def keyset_page(t):
    rows = t.files.select("file_id", "path", "created_at")
    return page(rows, 50, ("2024-01-01 02:30:00", "f150"), "file_id")


@query("segments_page", """
SELECT segment_id, profile_id, ordinal FROM segments WHERE version_id = 'v3-1' AND ordinal >= 0 ORDER BY profile_id, ordinal LIMIT 51""")
def segments_page_query(t):
    return segments_page(t.segments, "v3-1").select("segment_id", "profile_id", "ordinal")


@query("latest_by", """
SELECT file_id, item_id, error_code, updated_at FROM items WHERE state = 'failed'
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY updated_at DESC, item_id DESC) = 1""")
def latest_by_query(t):
    failed = t.items.where("state = 'failed'").select("file_id", "item_id", "error_code", "updated_at")
    return latest_by(failed, ["file_id"], ["updated_at", "item_id"]).select("file_id", "item_id", "error_code", "updated_at")


@query("audit_page", "SELECT event_id AS id, event_type AS action, user_id AS actor FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 51")
def audit_page_query(t):
    events = t.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").alias("actor"))
    return audit_page(events, 50, 900)


@query("expired_sessions", """
SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 90 DAY < TIMESTAMP '1997-06-01'""")
def expired_sessions_query(t):
    """Orders as upload sessions that end after ninety days."""
    sessions = t.raw("orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("committed").alias("state"),
                                      (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 90 days")).alias("expires_at"))
    return expired_sessions(sessions, ntz("1997-06-01 00:00:00")).select("session_id")


@query("expired_assets", """
SELECT event_id AS asset_id FROM events WHERE event_type = 'click' AND ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-20 00:00:00'""")
def expired_assets_query(t):
    """Clicks as query assets that are kept for a day."""
    assets = t.raw("events").where("event_type = 'click'").select(F.col("event_id").alias("asset_id"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    return expired_assets(assets, ntz(CUTOFF)).select("asset_id")
