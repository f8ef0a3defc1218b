"""Request windows and exactly-once usage over streams."""

from pyspark.sql import DataFrame, functions as F

DEFAULT_REQUESTS_PER_MINUTE = 600  # fixed value


def rate_windows(requests: DataFrame, plans: DataFrame, default: int = DEFAULT_REQUESTS_PER_MINUTE,
                 watermark: str = "10 minutes") -> DataFrame:
    """Hits of every principal per minute against its plan: allowed, refused, remaining.

    ``requests(workspace_id, principal, at)`` is a stream or a table; ``plans`` = workspaces with their plan (static).
    """
    limits = plans.select("workspace_id", F.col("plan.limits.requests_per_minute").alias("plan_limit"))
    rows = requests.withWatermark("at", watermark) if requests.isStreaming else requests
    counted = rows.groupBy("workspace_id", "principal", F.window("at", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("hits"))
    limit = F.coalesce("plan_limit", F.lit(default)).cast("long")
    return (counted.join(limits, "workspace_id", "left").withColumn("request_limit", limit)
            .select("workspace_id", "principal", F.col("w.start").alias("window_start"), "hits", "request_limit",
                    F.least("hits", "request_limit").alias("allowed"),
                    F.greatest(F.col("hits") - F.col("request_limit"), F.lit(0)).alias("refused"),
                    F.greatest(F.col("request_limit") - F.col("hits"), F.lit(0)).alias("remaining")))


def usage_days(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Usage per workspace, kind and day with repeated idempotency keys dropped.

    On a stream the horizon of repeats is the watermark: state stays bounded, and facts later than it are dropped. On a
    table every repeat is found. Months are sums of days, see :func:`months_of`.
    """
    if events.isStreaming:
        once = events.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["workspace_id", "idem_key"])
    else:
        first = F.min(F.struct("created_at", "kind", "quantity")).alias("e")
        once = events.groupBy("workspace_id", "idem_key").agg(first).select("workspace_id", "e.*")
    return once.groupBy("workspace_id", "kind", F.window("created_at", "1 day").alias("w")).agg(
        F.sum("quantity").alias("quantity")).select("workspace_id", "kind", F.col("w.start").alias("day"), "quantity")


def months_of(days: DataFrame) -> DataFrame:
    """Month totals from day totals."""
    return days.groupBy("workspace_id", "kind", F.date_trunc("month", "day").alias("month")).agg(
        F.sum("quantity").cast("long").alias("quantity"))
