"""Usage, storage, quotas, request figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.functions.metadata import stored_bytes

GIB = 1073741824
INDEX_KINDS = ["index_text_tokens", "index_media_tokens"]
QUERY_KINDS = ["query_text_tokens", "query_media_tokens"]
USAGE_KINDS = INDEX_KINDS + QUERY_KINDS
WARN_PERCENT = 80.0  # fixed value
LATENCY_BOUNDS = [0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]  # fixed values, seconds
UUID_PATTERN = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # fixed value


def dedup_usage(events: DataFrame) -> DataFrame:
    """One fact per (workspace, idempotency key): the earliest. Map-side combined, so a key repeated very often is
    reduced before the shuffle."""
    first = F.min(F.struct("created_at", "kind", "quantity")).alias("e")
    return events.groupBy("workspace_id", "idem_key").agg(first).select(
        "workspace_id", "idem_key", "e.kind", "e.quantity", "e.created_at")


def month_totals(events: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Totals by workspace and UTC month. ``kinds``: one column per kind; without it, one row per kind."""
    month = F.date_trunc("month", "created_at").alias("month")
    keys = events.groupBy("workspace_id", month)
    if kinds is None:
        return events.groupBy("workspace_id", month, "kind").agg(F.sum("quantity").cast("long").alias("quantity"))
    return keys.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("quantity"))), F.lit(0)).cast("long").alias(k)
                      for k in kinds])


def storage_by_category(blobs: DataFrame, segments: DataFrame, files: DataFrame, dims: int = 768) -> DataFrame:
    """Bytes per workspace: originals once, prepared text, vectors, metadata, total."""
    originals = blobs.groupBy("workspace_id").agg(F.sum("size").alias("originals_bytes"))
    prepared = segments.groupBy("workspace_id").agg(
        F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("prepared_bytes"),
        (F.count(F.lit(1)) * F.lit(4 * dims)).alias("vector_bytes"))
    meta = files.groupBy("workspace_id").agg(F.sum(stored_bytes(F.col("metadata"))).alias("metadata_bytes"))
    names = ["originals_bytes", "prepared_bytes", "vector_bytes", "metadata_bytes"]
    both = originals.join(prepared, "workspace_id", "full").join(meta, "workspace_id", "full")
    filled = both.select("workspace_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return filled.withColumn("total_bytes", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def gib_months(samples: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Time-weighted GiB of the month of ``now``: every sample holds until the next one, the last until ``now``.

    ``samples(workspace_id, at, bytes)``, ``current(workspace_id, bytes)``. Samples of the hour before the month count
    from its start. Intervals are closed inside each hour; only the first sample of an hour crosses an hour border, so a
    workspace with very many samples is spread over its hours.
    """
    month = F.date_trunc("month", now)
    points = (samples.where((F.col("at") >= month - F.expr("interval 1 hour")) & (F.col("at") < now))
              .select("workspace_id", F.greatest("at", month).alias("t"), "at", "bytes"))
    points = points.withColumn("hour", F.date_trunc("hour", "t"))
    firsts = points.groupBy("workspace_id", "hour").agg(F.min(F.struct("t", "at")).alias("f"))
    later = firsts.select("workspace_id", "hour", F.lead("f.t").over(
        W.partitionBy("workspace_id").orderBy("hour")).alias("next_hour"))
    inside = W.partitionBy("workspace_id", "hour").orderBy("t", "at")
    held = (points.withColumn("next", F.lead("t").over(inside)).join(later, ["workspace_id", "hour"])
            .withColumn("until", F.coalesce("next", "next_hour", now)))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    area = (F.col("bytes").cast("decimal(38,0)") * (micros(F.col("until")) - micros(F.col("t"))))
    month_micros = micros(F.add_months(month, 1)) - micros(month)
    total = held.groupBy("workspace_id").agg(F.sum(area).alias("byte_micros"))
    return current.join(total, "workspace_id", "left").select(
        "workspace_id", (F.coalesce(F.col("byte_micros").cast("double"), F.lit(0.0)) / F.lit(float(GIB))
                         / month_micros.cast("double")).alias("gib_months"))


def percent(used: Column, limit: Column) -> Column:
    return F.round(used / limit * 1000) / 10


def quota_report(storage: DataFrame, totals: DataFrame, plans: DataFrame) -> DataFrame:
    """Use against allowance per workspace: remaining amounts, warnings from 80 %, what is refused.

    ``storage(workspace_id, total_bytes)``, ``totals`` = month totals with one column per usage kind, ``plans`` =
    workspaces with their plan. A plan that allows excess refuses nothing.
    """
    index = sum((F.coalesce(F.col(k), F.lit(0)) for k in INDEX_KINDS), F.lit(0)).cast("long")
    query = sum((F.coalesce(F.col(k), F.lit(0)) for k in QUERY_KINDS), F.lit(0)).cast("long")
    rows = (plans.select("workspace_id", "plan.allow_excess", "plan.limits.*").join(storage, "workspace_id", "left")
            .join(totals, "workspace_id", "left").withColumn("total_bytes", F.coalesce("total_bytes", F.lit(0)))
            .withColumn("index_tokens", index).withColumn("query_tokens", query))
    figures = [("storage", "total_bytes", "storage_bytes"), ("indexing", "index_tokens", "index_tokens_month"),
               ("queries", "query_tokens", "query_tokens_month")]
    warn = [F.when(percent(F.col(u), F.col(m)) >= WARN_PERCENT, name) for name, u, m in figures]
    # storage and query use are refused above the limit, indexing from the limit on
    refuse = [F.when(~F.col("allow_excess") & ((F.col(u) >= F.col(m)) if name == "indexing" else
                                               (F.col(u) > F.col(m))), name) for name, u, m in figures]
    return rows.select("workspace_id", "total_bytes", "index_tokens", "query_tokens",
                       *[F.greatest(F.col(m) - F.col(u), F.lit(0)).alias(f"remaining_{name}") for name, u, m in figures],
                       F.array_compact(F.array(*warn)).alias("warnings"),
                       F.array_compact(F.array(*refuse)).alias("refused"))


def latency_histogram(requests: DataFrame, keys: Sequence[str], seconds: str = "seconds",
                      bounds: Sequence[float] = tuple(LATENCY_BOUNDS)) -> DataFrame:
    """Cumulative buckets per key: (keys, le, n). One pass with a counter per bound instead of a range join."""
    counted = requests.groupBy(*keys).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("b_inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("n")))
    return counted.select(*keys, F.explode(F.array(*pairs)).alias("b")).select(*keys, "b.le", "b.n")


def route_pattern(path: Column) -> Column:
    """Path with ids and part numbers replaced, so that few patterns remain."""
    return F.regexp_replace(F.regexp_replace(path, UUID_PATTERN, ":id"), r"/parts/\d+$", "/parts/:n")


def route_counts(requests: DataFrame) -> DataFrame:
    """Requests by method, route pattern and status."""
    return requests.groupBy("method", route_pattern(F.col("path")).alias("route"), "status").agg(
        F.count(F.lit(1)).alias("requests"))
