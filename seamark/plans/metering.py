"""Queries of metering, requests and the streaming operators in their batch form."""

from pyspark.sql import functions as F

from seamark.operators.metering import (LATENCY_BOUNDS, USAGE_KINDS, dedup_usage, gib_months, latency_histogram,
                                        month_totals, quota_report, route_counts, storage_by_category)
from seamark.plans.bindings import NOW, ntz
from seamark.plans.registry import query
from seamark.streaming.alerts import Rule, Signal, evaluate_alerts, quantile_from_buckets
from seamark.streaming.liveness import silent_sources
from seamark.streaming.metering import months_of, rate_windows, usage_days

_ONCE = """
once AS (SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY workspace_id, idem_key ORDER BY created_at, kind, quantity) = 1),
month AS (SELECT workspace_id, date_trunc('month', created_at) AS month, kind, CAST(sum(quantity) AS BIGINT) AS quantity FROM once GROUP BY ALL)"""
_STORAGE = """
cat AS (SELECT * FROM (SELECT workspace_id, CAST(sum(size) AS BIGINT) AS originals_bytes FROM blobs GROUP BY ALL)
  FULL JOIN (SELECT workspace_id, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS prepared_bytes, count(*) * 256 AS vector_bytes
    FROM segments GROUP BY ALL) USING (workspace_id)
  FULL JOIN (SELECT workspace_id, CAST(sum(strlen('{"lang": ' || m_lang || ', "source": ' || m_source || coalesce(', "quality": ' ||
    m_quality, '') || coalesce(', "toxic": ' || m_toxic, '') || '}')) AS BIGINT) AS metadata_bytes FROM files GROUP BY ALL) USING (workspace_id)),
storage AS (SELECT workspace_id, coalesce(originals_bytes, 0) AS originals_bytes, coalesce(prepared_bytes, 0) AS prepared_bytes,
  coalesce(vector_bytes, 0) AS vector_bytes, coalesce(metadata_bytes, 0) AS metadata_bytes, coalesce(originals_bytes, 0) +
  coalesce(prepared_bytes, 0) + coalesce(vector_bytes, 0) + coalesce(metadata_bytes, 0) AS total_bytes FROM cat)"""


@query("dedup_usage", f"WITH {_ONCE} SELECT workspace_id, idem_key, kind, quantity, created_at FROM once")
def dedup_usage_query(t):
    return dedup_usage(t.usage)


@query("month_totals", f"WITH {_ONCE} SELECT workspace_id, month::TIMESTAMP AS month, kind, quantity FROM month")
def month_totals_query(t):
    return month_totals(dedup_usage(t.usage)).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("usage_days", """
WITH once AS (SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY workspace_id, idem_key ORDER BY created_at, kind, quantity) = 1)
SELECT workspace_id, kind, date_trunc('month', created_at)::TIMESTAMP AS month, CAST(sum(quantity) AS BIGINT) AS quantity FROM once GROUP BY ALL""")
def usage_days_query(t):
    return months_of(usage_days(t.usage)).withColumn("month", F.col("month").cast("timestamp_ntz")).select(
        "workspace_id", "kind", "month", "quantity")


@query("storage_bytes", f"WITH {_STORAGE} SELECT * FROM storage")
def storage_bytes(t):
    return storage_by_category(t.blobs, t.segments, t.files, 64)


def _samples(t):
    return t.raw("events").select(F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"),
                                  F.col("ts").alias("at"), F.floor(F.col("value") * 1000000).cast("long").alias("bytes"))


@query("gib_months", f"""
WITH s AS (SELECT 'w' || (user_id % 3) AS workspace_id, ts AS taken, CAST(floor(value * 1000000) AS BIGINT) AS bytes FROM events),
p AS (SELECT workspace_id, greatest(taken, TIMESTAMP '2024-01-01') AS t, bytes FROM s WHERE taken >= TIMESTAMP '2023-12-31 23:00:00'
      AND taken < TIMESTAMP '{NOW}'),
l AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY workspace_id ORDER BY t), TIMESTAMP '{NOW}') AS nt FROM p)
SELECT workspace_id, round(CAST(sum(bytes::DOUBLE * (epoch_us(nt) - epoch_us(t))) AS DOUBLE) / 1073741824.0 / (31 * 86400.0 * 1000000), 8)
  AS gib_months FROM l GROUP BY workspace_id""")
def gib_months_query(t):
    samples = _samples(t)
    current = samples.groupBy("workspace_id").agg(F.max_by("bytes", "at").alias("bytes"))
    return gib_months(samples, current, ntz(NOW)).withColumn("gib_months", F.round("gib_months", 8))


@query("quota_report", f"""WITH {_ONCE}, {_STORAGE},
tot AS (SELECT workspace_id, CAST(coalesce(sum(quantity) FILTER (kind LIKE 'index%'), 0) AS BIGINT) AS i,
  CAST(coalesce(sum(quantity) FILTER (kind LIKE 'query%'), 0) AS BIGINT) AS q FROM month WHERE month = TIMESTAMP '2024-01-01' GROUP BY ALL),
r AS (SELECT w.*, coalesce(total_bytes, 0) AS total_bytes, coalesce(i, 0) AS index_tokens, coalesce(q, 0) AS query_tokens
  FROM workspaces w LEFT JOIN storage USING (workspace_id) LEFT JOIN tot USING (workspace_id))
SELECT workspace_id, total_bytes, index_tokens, query_tokens,
  CAST(greatest(storage_bytes - total_bytes, 0) AS BIGINT) AS remaining_storage,
  CAST(greatest(index_tokens_month - index_tokens, 0) AS BIGINT) AS remaining_indexing,
  CAST(greatest(query_tokens_month - query_tokens, 0) AS BIGINT) AS remaining_queries,
  concat_ws(',', CASE WHEN total_bytes >= 0.8 * storage_bytes THEN 'storage' END, CASE WHEN index_tokens >= 0.8 * index_tokens_month THEN
    'indexing' END, CASE WHEN query_tokens >= 0.8 * query_tokens_month THEN 'queries' END) AS warnings,
  concat_ws(',', CASE WHEN NOT allow_excess AND total_bytes > storage_bytes THEN 'storage' END, CASE WHEN NOT allow_excess AND
    index_tokens >= index_tokens_month THEN 'indexing' END, CASE WHEN NOT allow_excess AND query_tokens > query_tokens_month THEN 'queries'
    END) AS refused FROM r""")
def quota_report_query(t):
    totals = month_totals(dedup_usage(t.usage), USAGE_KINDS).where(F.col("month") == ntz("2024-01-01 00:00:00"))
    storage = storage_by_category(t.blobs, t.segments, t.files, 64).select("workspace_id", "total_bytes")
    rows = quota_report(storage, totals, t.workspaces)
    return rows.withColumn("warnings", F.array_join("warnings", ",")).withColumn("refused", F.array_join("refused", ","))


_BOUNDS_SQL = ", ".join(str(b) for b in LATENCY_BOUNDS)


@query("latency_histogram", f"""
WITH b AS (SELECT unnest([{_BOUNDS_SQL}, 1e300]::DOUBLE[]) AS le)
SELECT event_type AS route, CASE WHEN le = 1e300 THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count(*) FILTER (value / 40 <= le) AS n
FROM events, b GROUP BY ALL""")
def latency_histogram_query(t):
    requests = t.raw("events").select(F.col("event_type").alias("route"), (F.col("value") / 40).alias("seconds"))
    rows = latency_histogram(requests, ["route"])
    return rows.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@query("route_counts", """
WITH r AS (SELECT '/v1/' || regexp_extract(url, '/([a-z]{2})/', 1) || '/' || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' ||
  substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) || CASE WHEN page_id % 2 = 0 THEN
  '/parts/' || page_id ELSE '/content' END AS path, CASE WHEN page_id % 2 = 0 THEN 'PUT' ELSE 'GET' END AS method,
  CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status FROM pages)
SELECT method, regexp_replace(regexp_replace(path, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', ':id', 'g'),
  '/parts/[0-9]+$', '/parts/:n') AS route, status, count(*) AS requests FROM r GROUP BY ALL""")
def route_counts_query(t):
    digest = F.md5(F.col("url").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    even = F.col("page_id") % 2 == 0
    tail = F.when(even, F.concat(F.lit("/parts/"), F.col("page_id").cast("string"))).otherwise("/content")
    path = F.concat(F.lit("/v1/"), F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("/"), uuid, tail)
    return route_counts(t.raw("pages").select(path.alias("path"), F.when(even, "PUT").otherwise("GET").alias("method"),
                                              F.when(F.col("page_id") % 9 == 0, 404).otherwise(200).alias("status")))


@query("rate_windows", """
SELECT 'w' || (user_id % 3) AS workspace_id, event_type AS principal, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS hits,
  CAST(coalesce(any_value(requests_per_minute), 600) AS BIGINT) AS request_limit,
  CAST(least(count(*), coalesce(any_value(requests_per_minute), 600)) AS BIGINT) AS allowed,
  CAST(greatest(count(*) - coalesce(any_value(requests_per_minute), 600), 0) AS BIGINT) AS refused,
  CAST(greatest(coalesce(any_value(requests_per_minute), 600) - count(*), 0) AS BIGINT) AS remaining
FROM events JOIN workspaces w ON w.workspace_id = 'w' || (user_id % 3) GROUP BY 1, 2, 3""")
def rate_windows_query(t):
    requests = t.raw("events").select(F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"),
                                      F.col("event_type").alias("principal"), F.col("ts").alias("at"))
    return rate_windows(requests, t.workspaces).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("silent_sources", f"""
SELECT user_id AS source, max(ts) AS last_beat, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1000000.0, 3)::DOUBLE AS silent_seconds
FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id HAVING max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 1 DAY""")
def silent_sources_query(t):
    beats = t.raw("events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"))
    return silent_sources(beats, ntz(NOW), 86400.0).withColumn("silent_seconds", F.round("silent_seconds", 3))


HOUR = 3600
RULES = [
    Rule("purchases_high", [(Signal("purchase"), ">", 40.0)], 1),
    Rule("clicks_busy", [(Signal("click", "average", 6), ">", 60.0), (Signal("view", "average", 6), ">", 20.0)], 2),
    Rule("signups_jump", [(Signal("signup", "delta", 12, {"bucket": "[01]"}, summed=True), ">", 10.0)]),
    Rule("errors_share", [(Signal("error", "rate", 6, {"bucket": "0"}, summed=True), ">", 0.2)], 1, Signal("error", "rate", 6, summed=True)),
]


@query("alerts", f"""
WITH m AS (SELECT event_type AS name, user_id % 4 AS bucket, CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS step, ts, value FROM events),
s AS (SELECT name, bucket, step, arg_max(value, ts) AS value FROM m GROUP BY ALL),
avg6 AS (SELECT name, bucket, step, avg(value) OVER (PARTITION BY name, bucket ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM s),
low AS (SELECT step, sum(value) AS v FROM s WHERE name = 'signup' AND bucket IN (0, 1) GROUP BY ALL),
grown AS (SELECT *, coalesce(CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w WHEN lag(value) OVER w IS NOT NULL THEN value
  END, 0) AS g FROM s WINDOW w AS (PARTITION BY name, bucket ORDER BY step)),
rate AS (SELECT step, sum(v) OVER (ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) / (6 * {HOUR}) AS r FROM
  (SELECT step, sum(g) AS v FROM grown WHERE name = 'error' GROUP BY step)),
rate0 AS (SELECT step, sum(v) OVER (ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) / (6 * {HOUR}) AS r FROM
  (SELECT step, sum(g) AS v FROM grown WHERE name = 'error' AND bucket = 0 GROUP BY step)),
state AS (
  SELECT 'purchases_high' AS rule, bucket, 1 AS hold, step, value, value > 40 AS holds FROM s WHERE name = 'purchase'
  UNION ALL SELECT 'clicks_busy', c.bucket, 2, c.step, c.a, c.a > 60 AND v.a > 20 FROM avg6 c JOIN avg6 v ON v.step = c.step
    AND v.bucket = c.bucket AND v.name = 'view' WHERE c.name = 'click'
  UNION ALL SELECT 'signups_jump', NULL, 0, step, d, d > 10 FROM (SELECT step, v - first_value(v) OVER (ORDER BY step RANGE BETWEEN 12 PRECEDING
    AND CURRENT ROW) AS d FROM low)
  UNION ALL SELECT 'errors_share', NULL, 1, step, q, q > 0.2 FROM (SELECT r.step, coalesce(r0.r, 0) / greatest(r.r, 1e-9) AS q FROM rate r
    LEFT JOIN rate0 r0 ON r0.step = r.step))
SELECT rule, coalesce('{{"bucket":"' || bucket || '"}}', '') AS series, step, round(value, 4) AS value, hold + 1 = sum(holds::INT) OVER (PARTITION BY rule, bucket ORDER BY step RANGE BETWEEN hold PRECEDING
  AND CURRENT ROW) AS firing FROM state""")
def alerts(t):
    metrics = t.raw("events").select("ts", F.col("event_type").alias("name"), F.create_map(
        F.lit("bucket"), (F.col("user_id") % 4).cast("string")).alias("labels"), "value")
    return evaluate_alerts(metrics, RULES, HOUR).withColumn("value", F.round("value", 4))


@query("p95_from_buckets", f"""
WITH b AS (SELECT unnest([{_BOUNDS_SQL}, 1e300]::DOUBLE[]) AS le),
per AS (SELECT CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS step, le, count(*) FILTER (value / 40 <= le)::DOUBLE AS n FROM events, b GROUP BY ALL),
s AS (SELECT step, le, sum(n) OVER (PARTITION BY le ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM per),
r AS (SELECT *, 0.95 * max(n) OVER (PARTITION BY step) AS rank FROM s),
e AS (SELECT step, min(le) FILTER (n >= rank) AS ule, coalesce(max(le) FILTER (n < rank), 0) AS lle, min(n) FILTER (n >= rank) AS un,
  coalesce(max(n) FILTER (n < rank), 0) AS ln, any_value(rank) AS rank FROM r GROUP BY step)
SELECT step, round(CASE WHEN ule = 1e300 THEN lle ELSE lle + (ule - lle) * (rank - ln) / (un - ln) END, 9) AS value FROM e""")
def p95_from_buckets(t):
    step = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / HOUR)
    requests = t.raw("events").select(step.alias("step"), (F.col("value") / 40).alias("seconds"))
    grown = latency_histogram(requests, ["step"]).select(
        "step", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"),
        F.col("n").cast("double").alias("grown"))
    return quantile_from_buckets(grown, 0.95, 6).withColumn("value", F.round("value", 9))
