"""Queries of the store algebra and the filters."""

import re

from pyspark.sql import functions as F

from seamark.functions.metadata import contains
from seamark.operators.filters import Filter, live, matches, restrict, scoped
from seamark.operators.statistics import (deletion_preview, file_status, finalize_jobs, gauges, job_counts,
                                          profile_aliases, store_activity, store_stats, store_summary)
from seamark.operators.stores import (dependents, derivation_check, file_references, merge_compatible, merge_rebuild,
                                      merge_report, merge_stores, newest_version, remove_members, resolve_all, shared_sources, snapshot,
                                      split_by_field)
from seamark.operators.store_changes import applied, candidates_of, member_changes, propagate
from seamark.operators.stores import members_direct
from seamark.plans.bindings import SQL_TABLES, ntz
from seamark.plans.registry import query
from seamark.session import cut_lineage

SOURCES = ["src3", "snap", "v_good", "src2"]
_ORD = "CASE store_id WHEN 'src3' THEN 0 WHEN 'snap' THEN 1 WHEN 'v_good' THEN 2 WHEN 'src2' THEN 3 END"
_MERGE_SQL = f"""
refs AS (SELECT *, {_ORD} AS ord FROM members WHERE store_id IN ('src3', 'snap', 'v_good', 'src2')),
chosen AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ord) = 1),
uniq AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY path, sha256 ORDER BY file_id) = 1),
merged AS (SELECT file_id, CASE WHEN store_id = 'snap' THEN version_id END AS pinned_version_id FROM uniq
           WHERE version_id IN (SELECT version_id FROM p1))"""


@query("members_direct", "SELECT store_id, file_id, version_id FROM direct")
def members_direct_query(t):
    return t.direct.select("store_id", "file_id", "version_id")


@query("members_view", "SELECT store_id, file_id, version_id FROM level1")
def members_view(t):
    from seamark.operators.stores import resolve_views
    views = t.stores.where("kind = 'view' and deleted_at is null and definition.depth = 1")
    return resolve_views(views, t.direct).select("store_id", "file_id", "version_id")


@query("members_nested", "SELECT store_id, file_id, version_id, path FROM members")
def members_nested(t):
    return t.members.select("store_id", "file_id", "version_id", "path")


@query("distinct_on_newest", """
SELECT workspace_id AS store_id, file_id, version_id, version_no FROM versions
QUALIFY row_number() OVER (PARTITION BY workspace_id, file_id ORDER BY version_no DESC NULLS LAST, version_id) = 1""")
def distinct_on_newest(t):
    facts = t.files.select("file_id", "path", "metadata")
    rows = t.versions.join(facts, "file_id").withColumn("store_id", F.col("workspace_id"))
    return newest_version(rows).select("store_id", "file_id", "version_id", "version_no")


@query("snapshot", "SELECT 'frozen' AS store_id, file_id, version_id AS pinned_version_id FROM members WHERE store_id = 'v_top'")
def snapshot_query(t):
    return snapshot(t.members, "v_top", "frozen")


@query("view_depth", """
WITH asked AS (SELECT DISTINCT 'by ' || s.source AS name, unnest([s.source, CASE WHEN s.source IN ('src1', 'src2') THEN 'v_top'
  WHEN s.source = 'src3' THEN 'v_deep' WHEN s.source = 'src4' THEN 'nowhere' ELSE 'snap' END]) AS store_id FROM documents s),
p AS (SELECT s.store_id, coalesce(v.depth, 0) AS d FROM stores s LEFT JOIN views v USING (store_id) WHERE s.deleted_at IS NULL)
SELECT name, CAST(max(d) + 1 AS INTEGER) AS depth, CASE WHEN count(*) FILTER (d IS NULL) > 0 THEN 'RESOURCE_NOT_FOUND'
  WHEN max(d) + 1 > 3 THEN 'INVALID_REQUEST' END AS error FROM asked LEFT JOIN p USING (store_id) GROUP BY name""")
def view_depth(t):
    s = F.col("source")
    second = (F.when(s.isin("src1", "src2"), "v_top").when(s == "src3", "v_deep").when(s == "src4", "nowhere").otherwise("snap"))
    wanted = t.raw("documents").select(F.concat(F.lit("by "), s).alias("name"), F.array(s, second).alias("parents")).distinct()
    return derivation_check(wanted, t.stores, t.revisions).select("name", "depth", "error")


@query("split_by_field", """
SELECT v AS value, m_lang AS literal, 'Store src1-' || v AS name, n AS files, 'created' AS outcome FROM (
  SELECT m_lang, trim(m_lang, '"') AS v, count(*) AS n FROM members WHERE store_id = 'src1' AND m_lang IS NOT NULL GROUP BY m_lang)""")
def split_by_field_query(t):
    return split_by_field(t.members, t.stores, "src1", "lang", "Store src1")


@query("merge_stores", f"WITH {_MERGE_SQL} SELECT 'merged' AS store_id, file_id, pinned_version_id FROM merged")
def merge_stores_query(t):
    return merge_stores(t.members, t.stores, t.segments, SOURCES, "merged", "p1")


@query("merge_report", f"""WITH {_MERGE_SQL}
SELECT (SELECT count(*) FROM refs) AS source_references, (SELECT count(*) FROM merged) AS memberships,
  (SELECT count(*) FROM refs) - (SELECT count(*) FROM uniq) AS duplicates_removed""")
def merge_report_query(t):
    return merge_report(t.members, t.stores, t.segments, SOURCES, "p1")


@query("merge_rebuild", f"""WITH {_MERGE_SQL}
SELECT file_id, version_id, (SELECT count(DISTINCT profile_id) FROM revisions WHERE state = 'active') AS profiles FROM chosen
WHERE version_id NOT IN (SELECT version_id FROM segments WHERE profile_id = 'p2')""")
def merge_rebuild_query(t):
    todo = merge_rebuild(t.members, t.stores, t.segments, SOURCES, "p2")
    compatible = merge_compatible(t.stores, t.revisions, SOURCES).select("profiles").scalar()
    return todo.select("file_id", "version_id", compatible.alias("profiles"))


@query("remove_members", """
SELECT store_id, file_id, pinned_version_id FROM store_files WHERE NOT (store_id <> 'snap' AND file_id IN (
  SELECT file_id FROM files WHERE m_toxic = '1'))""")
def remove_members_query(t):
    toxic = t.files.where(contains(F.col("metadata"), {"toxic": 1})).select("file_id")
    removals = t.store_files.where("store_id <> 'snap'").join(toxic, "file_id", "left_semi").select("store_id", "file_id")
    return remove_members(t.store_files, t.stores, removals).select("store_id", "file_id", "pinned_version_id")


_SHARED_SQL = """
others AS (SELECT DISTINCT file_id FROM store_files JOIN stores USING (store_id) WHERE store_id <> 'src3' AND deleted_at IS NULL),
shared AS (SELECT sf.store_id, sf.file_id, o.file_id IS NOT NULL AS shared FROM store_files sf LEFT JOIN others o USING (file_id)
           WHERE sf.store_id = 'src3')"""


@query("shared_sources", f"WITH {_SHARED_SQL} SELECT store_id, file_id, shared FROM shared")
def shared_sources_query(t):
    return shared_sources(t.store_files, t.stores, "src3").select("store_id", "file_id", "shared")


@query("deletion_preview", f"""WITH {_SHARED_SQL}
SELECT store_id, count(*) AS memberships, count(*) FILTER (shared) AS shared_sources, count(*) FILTER (NOT shared) AS
  deleted_if_unshared FROM shared GROUP BY store_id""")
def deletion_preview_query(t):
    return deletion_preview(shared_sources(t.store_files, t.stores, "src3"))


@query("dependents", """
SELECT v.store_id, 'View ' || v.store_id AS name, (SELECT count(*) FROM members m WHERE m.store_id = v.store_id) AS files
FROM views v WHERE NOT gone AND list_contains(parents, 'src1')""")
def dependents_query(t):
    sizes = t.members.groupBy("store_id").agg(F.count(F.lit(1)).alias("files"))
    return dependents(t.stores, "src1").join(sizes, "store_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("file_references", """
SELECT store_id, name, kind FROM stores WHERE deleted_at IS NULL AND store_id IN (SELECT store_id FROM members WHERE file_id = 'f22')""")
def file_references_query(t):
    return file_references(t.members, t.stores, "f22")


@query("filter_metadata", "SELECT file_id FROM files WHERE m_lang = '\"en\"' AND m_quality = '1'")
def filter_metadata(t):
    return t.files.where(contains(F.col("metadata"), {"lang": "en", "quality": 1})).select("file_id")


@query("filter_path", """
SELECT f.file_id, v.version_id FROM files f JOIN versions v ON v.file_id = f.file_id
WHERE starts_with(path, 'src1') AND media_type IN ('text/plain', 'image/png') AND deleted_at IS NULL AND f.workspace_id = 'w1'""")
def filter_path(t):
    rows = live(scoped(t.files, "w1")).join(t.versions.select("file_id", "version_id", "media_type"), "file_id")
    return rows.where(matches(Filter(path_prefix="src1", media_types=["text/plain", "image/png"]))).select("file_id", "version_id")


@query("restrict_scope", """
SELECT segment_id, version_id FROM p1 WHERE version_id IN (SELECT version_id FROM members WHERE store_id IN ('v_en', 'src7'))""")
def restrict_scope(t):
    return restrict(t.p1, t.members, ["v_en", "src7"]).select("segment_id", "version_id")


@query("store_stats", """
WITH z AS (SELECT store_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS source_bytes FROM members m JOIN versions v
           ON v.version_id = m.version_id GROUP BY ALL),
b AS (SELECT store_id, modality, count(*) AS n FROM members JOIN p1 USING (version_id) GROUP BY ALL)
SELECT store_id, coalesce(files, 0) AS files, coalesce(source_bytes, 0) AS source_bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS segments,
  string_agg(modality || '=' || n, ',' ORDER BY modality) AS by_modality
FROM (SELECT store_id FROM stores WHERE deleted_at IS NULL) LEFT JOIN z USING (store_id) LEFT JOIN b USING (store_id) GROUP BY ALL""")
def store_stats_query(t):
    pairs = F.transform(F.array_sort(F.map_entries("by_modality")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return store_stats(t.stores, t.members, t.versions, t.segments, "p1").withColumn("by_modality", F.array_join(pairs, ","))


@query("store_summary", """
SELECT s.store_id, s.kind, count(DISTINCT m.file_id) AS files, count(p.segment_id) AS segments,
  CASE WHEN count(p.segment_id) > 0 THEN 'ready' ELSE 'empty' END AS state
FROM stores s LEFT JOIN members m USING (store_id) LEFT JOIN p1 p ON p.version_id = m.version_id WHERE s.deleted_at IS NULL GROUP BY ALL""")
def store_summary_query(t):
    return store_summary(t.stores, t.members, t.segments, "p1").select("store_id", "kind", "files", "segments", "state")


@query("file_status", """
WITH j AS (SELECT file_id, count(*) FILTER (state IN ('queued', 'running')) AS pending,
  arg_max(error_code, (updated_at, item_id)) FILTER (state = 'failed') AS last_error FROM items GROUP BY file_id),
sg AS (SELECT version_id, count(*) AS n, string_agg(DISTINCT profile_id, ',' ORDER BY profile_id) AS profiles FROM segments GROUP BY ALL),
st AS (SELECT file_id, string_agg(DISTINCT store_id, ',' ORDER BY store_id) AS stores FROM store_files JOIN stores USING (store_id)
  WHERE deleted_at IS NULL GROUP BY file_id)
SELECT f.file_id, CASE WHEN coalesce(pending, 0) > 0 THEN 'processing' WHEN current_version_id IS NOT NULL THEN 'published'
  WHEN last_error IS NOT NULL THEN 'failed' ELSE 'pending' END AS status, coalesce(n, 0) AS segment_count,
  coalesce(profiles, '') AS profiles, last_error, coalesce(stores, '') AS stores
FROM files f LEFT JOIN j USING (file_id) LEFT JOIN sg ON sg.version_id = f.current_version_id LEFT JOIN st USING (file_id)""")
def file_status_query(t):
    rows = file_status(t.files, t.versions, t.items, t.segments, t.store_files, t.stores)
    return rows.select("file_id", "status", "segment_count", F.array_join("profiles", ",").alias("profiles"),
                       F.col("last_error.error_code").alias("last_error"), F.array_join("stores", ",").alias("stores"))


_COUNTS_SQL = """
counts AS (SELECT job_id, count(*) AS total, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running,
  count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed,
  count(*) FILTER (state = 'cancelled') AS cancelled, count(*) FILTER (state = 'failed' AND retryable) AS retryable
  FROM items GROUP BY job_id)"""


@query("job_counts", f"WITH {_COUNTS_SQL} SELECT * FROM counts")
def job_counts_query(t):
    return job_counts(t.items)


@query("finalize_jobs", f"""WITH {_COUNTS_SQL}
SELECT j.job_id, j.state AS old_state, CASE WHEN j.state IN ('completed', 'completed_with_errors', 'failed', 'cancelled') THEN j.state
  WHEN queued + running > 0 AND j.state = 'queued' AND (running > 0 OR succeeded + failed > 0) THEN 'running'
  WHEN queued + running > 0 THEN j.state WHEN j.state = 'cancel_requested' OR cancelled > 0 THEN 'cancelled'
  WHEN failed = 0 THEN 'completed' WHEN succeeded > 0 THEN 'completed_with_errors' ELSE 'failed' END AS state
FROM jobs j JOIN counts c USING (job_id)""")
def finalize_jobs_query(t):
    return finalize_jobs(t.jobs, t.items)


@query("gauges", """
SELECT 'workspaces' AS name, '' AS labels, count(*)::DOUBLE AS value FROM workspaces
UNION ALL SELECT 'stores', 'kind="' || kind || '"', count(*)::DOUBLE FROM stores WHERE deleted_at IS NULL GROUP BY kind
UNION ALL SELECT 'segments', '', count(*)::DOUBLE FROM segments
UNION ALL SELECT 'blob_bytes', '', coalesce(sum(size), 0)::DOUBLE FROM blobs
UNION ALL SELECT 'jobs', 'state="' || state || '"', count(*)::DOUBLE FROM jobs GROUP BY state
UNION ALL SELECT 'job_items', 'state="' || state || '"', count(*)::DOUBLE FROM items GROUP BY state""")
def gauges_query(t):
    return gauges(t.workspaces, t.stores, t.segments, t.blobs, t.jobs, t.items)


@query("profile_aliases", """
SELECT profile_id, 'document=' || profile_id || '-document,query=' || profile_id || '-query' AS aliases
FROM (SELECT DISTINCT profile_id FROM segments)""")
def profile_aliases_query(t):
    purpose = F.explode(F.array(F.lit("query"), F.lit("document"))).alias("purpose")
    aliases = t.segments.select("profile_id", purpose).distinct().withColumn("alias", F.concat_ws("-", "profile_id", "purpose"))
    pairs = F.transform(F.array_sort(F.map_entries("aliases")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return profile_aliases(aliases).select("profile_id", F.array_join(pairs, ",").alias("aliases"))


def _members_again(files: str, store_files: str) -> str:
    """The member CTEs once more, over changed tables."""
    body = SQL_TABLES[SQL_TABLES.index("direct AS ("):SQL_TABLES.index("blobs AS (")].rstrip().rstrip(",")
    for name in ("direct", "level1", "level2", "level3", "upto1", "upto2", "members"):
        body = re.sub(rf"\b{name}\b", name + "_new", body)
    return re.sub(r"\bfiles f\b", files + " f", re.sub(r"\bstore_files sf\b", store_files + " sf", body))


@query("members_delta", f"""
WITH files_new AS (SELECT * REPLACE (CASE WHEN doc_id % 19 = 4 THEN TIMESTAMP '2024-01-30' ELSE deleted_at END AS deleted_at,
    CASE WHEN doc_id % 10 = 5 THEN 'v' || doc_id || '-1' ELSE current_version_id END AS current_version_id,
    CASE WHEN doc_id % 8 = 1 THEN '"en"' ELSE m_lang END AS m_lang) FROM files),
store_files_new AS (SELECT * FROM store_files WHERE NOT (store_id = 'snap' AND right(file_id, 1) = '8')
  UNION ALL SELECT 'src1', file_id, NULL FROM files WHERE doc_id % 21 = 1 AND file_id NOT IN (SELECT file_id FROM store_files WHERE store_id = 'src1')),
{_members_again("files_new", "store_files_new")}
SELECT store_id, file_id, version_id, path FROM members_new""")
def members_delta(t):
    """Files deleted, pointed back to their first version or given another language, members added and taken out: the members of all
    stores after it, from the members before and the changes."""
    n = F.regexp_extract("file_id", "[0-9]+", 0).cast("bigint")
    files = t.files.withColumns({
        "deleted_at": F.when(n % 19 == 4, ntz("2024-01-30 00:00:00")).otherwise(F.col("deleted_at")),
        "current_version_id": F.when(n % 10 == 5, F.concat(F.lit("v"), n.cast("string"), F.lit("-1"))).otherwise(F.col("current_version_id")),
        "metadata": F.when(n % 8 == 1, F.map_concat(F.map_filter("metadata", lambda k, _: k != "lang"), F.create_map(F.lit("lang"), F.lit('"en"')))).otherwise(
            F.col("metadata"))})
    there = t.store_files.where("store_id = 'src1'").select("file_id")
    added = t.files.where(n % 21 == 1).select("file_id").join(there, "file_id", "left_anti").select(
        F.lit("src1").alias("store_id"), "file_id", F.lit(None).cast("string").alias("pinned_version_id"))
    held = t.store_files.where(~((F.col("store_id") == "snap") & F.col("file_id").endswith("8"))).unionByName(added)
    views = t.stores.where(F.col("deleted_at").isNull() & (F.col("kind") == "view"))
    # stored as the jobs that keep them would find them: no level of views reads the texts or resolves the stores again
    versions = cut_lineage(t.versions.select("version_id", "file_id", "version_no", "media_type", "sha256"))
    members = resolve_all(t.stores, t.store_files, t.files, versions, checkpoint=True)
    candidates = cut_lineage(candidates_of(views, members))
    changes = member_changes(members_direct(t.stores, t.store_files, t.files, versions), members_direct(t.stores, held, files, versions))
    delta, _ = propagate(changes, candidates, views)
    return applied(members, delta).select("store_id", "file_id", "version_id", "path")


@query("store_activity", """
WITH own AS (SELECT 'src' || (CAST(substr(job_id, 2) AS BIGINT) % 20) AS store_id, state FROM jobs),
j AS (SELECT store_id, state, count(*) AS n FROM own GROUP BY ALL),
js AS (SELECT store_id, string_agg(state || '=' || n, ',' ORDER BY state) AS jobs FROM j GROUP BY store_id),
rs AS (SELECT store_id, string_agg(revision_id || '/' || profile_id || '=' || state, ',' ORDER BY revision_id) AS revisions FROM revisions GROUP BY store_id)
SELECT s.store_id, coalesce(jobs, '') AS jobs, coalesce(revisions, '') AS revisions FROM stores s LEFT JOIN js USING (store_id) LEFT JOIN rs USING (store_id)
WHERE s.deleted_at IS NULL""")
def store_activity_query(t):
    jobs = t.jobs.select(F.concat(F.lit("src"), (F.substring("job_id", 2, 20).cast("bigint") % 20).cast("string")).alias("store_id"), "state")
    rows = store_activity(t.stores, jobs, t.revisions)
    states = F.transform(F.array_sort(F.map_entries("jobs_by_state")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    indexes = F.transform("revisions", lambda r: F.concat(r["revision_id"], F.lit("/"), r["profile_id"], F.lit("="), r["state"]))
    return rows.select("store_id", F.array_join(states, ",").alias("jobs"), F.array_join(indexes, ",").alias("revisions"))
