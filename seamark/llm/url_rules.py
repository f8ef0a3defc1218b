"""Allow and block rules for URLs by a sort-merge range join.

A host is written with its labels reversed and a dot after each (``com.example.www.``), so a rule's host and all its
subdomains are the keys that begin with the rule's: an interval. Rules of the same path nest or are disjoint. Starts, ends
and URLs are sorted together; every start and end carries the stack of rules active after it, and a URL takes the last
stack before it. The sweep runs in ranges of the order in parallel, and one stack per range is carried over. A URL takes
part once for each length of path that rules have, so a rule's path is compared as a prefix of exactly that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.llm.common import ascii_lower, shared_table

END = "\U0010FFFF"  # sorts after whatever may follow a rule's key
ORDER = ["length", "prefix", "key", "kind", "tie"]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of (host, path, verdict) rules in sweep order, each with the stack that is active after it.

    Of equal rules a blocking one wins. A rule's stack are the rules of its path whose hosts lie above its own, found by an
    equi-join on each of the host's suffixes.
    """
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        "path", host_key(F.col("host")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    labels = F.split("key", r"\.")
    above = own.select("path", "key", F.explode(F.sequence(F.lit(1), F.size(labels) - 1)).alias("n")).select(
        "path", F.col("key").alias("below"), F.concat(F.array_join(F.slice(labels, 1, F.col("n")), "."), F.lit(".")).alias("key"))
    stacks = above.join(own, ["path", "key"]).groupBy("path", "below").agg(F.sort_array(F.collect_list(
        F.struct(F.length("key").alias("at"), "rule", "verdict"))).alias("stack"))  # as many as a host has labels
    placed = stacks.select(F.length("path").alias("length"), F.col("path").alias("prefix"), F.col("below").alias("key"), "stack")
    starts = placed.select("length", "prefix", "key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tie"), "stack")
    ends = placed.select("length", "prefix", F.concat("key", F.lit(END)).alias("key"), F.lit(2).alias("kind"),
                         F.lit(0).cast("bigint").alias("tie"), F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    return starts.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict; the longest rule that fits decides, else rule is null and ``default``.

    A null url, or one without ``://``, has an empty host and path. Repeated rows are all returned, judged once; existing
    columns named host, path, rule or verdict are replaced; an empty table gives no rows, no rules give the default.
    """
    spark = urls.sparkSession
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # a few numbers, however many rules
    kept = urls.drop("host", "path", "rule", "verdict")
    shown = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not lengths:
        return shown.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = kept.select(F.col(url).alias("url")).where("url is not null").distinct()
    points = distinct.select("url", host_key(host_of(F.col("url"))).alias("key"), path_of(F.col("url")).alias("path")).select(
        F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("length"), "url", "key", "path").where(
        F.length("path") >= F.col("length")).select(
        "length", F.expr("left(path, length)").alias("prefix"), "key", F.lit(1).alias("kind"), F.xxhash64("url").alias("tie"), "url")
    events = points.unionByName(rule_events(rules), allowMissingColumns=True)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = shared_table(events.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id()), "sweep")
    last = swept.groupBy("range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct(*ORDER))).alias("last"))
    carried = last.select("range", F.last("last", ignorenulls=True).over(
        W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))  # a row per range
    here = F.last("stack", ignorenulls=True).over(W.partitionBy("range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    found = swept.withColumn("here", here).where("kind = 1").join(F.broadcast(carried), "range").select(
        "url", F.try_element_at(F.coalesce("here", "carried"), F.lit(-1)).alias("top")).where("top is not null")
    best = found.groupBy("url").agg(F.max_by("top", F.length("top.rule")).alias("top")).select(
        F.col("url").alias("__url"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("__verdict"))
    return shown.join(best, shown[url] == best["__url"], "left").withColumn(
        "verdict", F.coalesce("__verdict", F.lit(default))).drop("__url", "__verdict")
