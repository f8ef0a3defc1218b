import datetime as dt

import pytest
from pyspark.sql import functions as F

from seamark.operators.metering import (gib_months, latency_histogram, month_totals, quota_report, route_pattern)
from seamark.plans.bindings import ntz
from seamark.streaming.alerts import trailing, OPERATING_RULES, evaluate_alerts
from seamark.streaming.liveness import lease_seconds, silent_sources

GIB = 1073741824


def samples(spark, rows):
    return spark.createDataFrame(rows, "workspace_id string, t string, bytes long").select(
        "workspace_id", F.col("t").cast("timestamp_ntz").alias("at"), "bytes")


def gib(spark, rows, now):
    current = spark.createDataFrame([("w", 0)], "workspace_id string, bytes long")
    return gib_months(samples(spark, rows), current, ntz(now)).first().gib_months


def test_gib_month_of_one_sample(spark):
    got = gib(spark, [("w", "2024-02-01 00:00:00", GIB)], "2024-02-11 00:00:00")
    assert abs(got - 10 / 29) < 1e-9


def test_gib_month_carry_in_and_gaps(spark):
    rows = [("w", "2024-01-31 22:00:00", 50 * GIB), ("w", "2024-01-31 23:30:00", GIB), ("w", "2024-02-03 12:00:00", 3 * GIB),
            ("w", "2024-02-03 18:00:00", 0), ("w", "2024-02-09 00:00:00", 2 * GIB)]
    want = (2.5 * 1 + 0.25 * 3 + 5.25 * 0 + 2 * 2) / 29
    assert abs(gib(spark, rows, "2024-02-11 00:00:00") - want) < 1e-9
    assert gib(spark, [], "2024-02-11 00:00:00") == 0


def test_quota(spark):
    plan = "workspace_id string, plan struct<name:string,allow_excess:boolean,limits:struct<storage_bytes:bigint,index_tokens_month:bigint,query_tokens_month:bigint,requests_per_minute:int>,features:map<string,boolean>>"
    plans = spark.createDataFrame([(w, ("p", x, (100, 100, 100, 1), {})) for w, x in [("a", False), ("b", True), ("c", False)]], plan)
    storage = spark.createDataFrame([("a", 101), ("b", 500), ("c", 79)], "workspace_id string, total_bytes long")
    totals = spark.createDataFrame([("a", 60, 40, 100, 0), ("b", 500, 0, 500, 0)],
                                   "workspace_id string, index_text_tokens long, index_media_tokens long, query_text_tokens long, query_media_tokens long")
    got = {r.workspace_id: r for r in quota_report(storage, totals, plans).collect()}
    assert got["a"].warnings == ["storage", "indexing", "queries"] and got["a"].refused == ["storage", "indexing"]
    assert got["b"].refused == [] and got["b"].remaining_storage == 0
    assert got["c"].warnings == [] and got["c"].remaining_queries == 100 and got["c"].remaining_storage == 21


def test_month_totals_and_routes(spark):
    rows = [("w", "a", 5, "2024-01-31 23:59:59"), ("w", "a", 7, "2024-02-01 00:00:00"), ("w", "b", 1, "2024-02-02 00:00:00")]
    df = spark.createDataFrame(rows, "workspace_id string, kind string, quantity long, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    got = {str(r.month.date()): (r.a, r.b) for r in month_totals(df, ["a", "b"]).collect()}
    assert got == {"2024-01-01": (5, 0), "2024-02-01": (7, 1)}
    paths = spark.createDataFrame([("/v1/files/6F1D3C52-7f0e-4a51-9a39-3f2f4c1b8e01/parts/12",), ("/v1/parts/x",)], "p string")
    assert [r[0] for r in paths.select(route_pattern(F.col("p"))).collect()] == ["/v1/files/:id/parts/:n", "/v1/parts/x"]
    hist = {r.le: r.n for r in latency_histogram(spark.createDataFrame([("r", 0.05), ("r", 0.3), ("r", 99.0)], "route string, seconds double"), ["route"]).collect()}
    assert (hist[0.025], hist[0.05], hist[0.25], hist[0.5], hist[10.0], hist[float("inf")]) == (0, 1, 1, 2, 2, 3)


def test_silent(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:00:00")], "source string, t string")
    beats = df.select("source", F.col("t").cast("timestamp").alias("at"))
    got = silent_sources(beats, F.lit("2024-01-01 00:00:30").cast("timestamp")).collect()
    assert [(r.source, r.silent_seconds) for r in got] == [("b", 30.0)] and lease_seconds(1) == 6.0


def series(spec):
    """Minute values in the short form start+step x count."""
    out = []
    for part in spec.split():
        if "x" in part:
            head, n = part.split("x")
            start, step = (head.split("+") + ["0"])[:2]
            out += [float(start) + float(step) * i for i in range(int(n) + 1)]
        else:
            out.append(float(part))
    return out


CASES = [
    ([("up", {"job": "api"}, "1 0 0 0"), ("up", {"job": "inference"}, "1 1 1 1"), ("workers_alive", {}, "1 0 0 0")], 3,
     {"ApiDown": True, "InferenceDown": False, "WorkersDown": True}),
    ([("queue_tasks", {"queue": "ingest", "status": "todo"}, "600x40"), ("job_items", {"state": "succeeded"}, "100x40"),
      ("job_items", {"state": "failed"}, "0 0 0 0 0 20x35")], None, {("QueueStalled", 35): True, ("QueueBacklog", 15): True, ("JobItemFailures", 10): True,
                                                                      ("JobItemFailures", 25): False, ("QueueBacklog", 9): False}),
    ([("queue_tasks", {"queue": "ingest", "status": "todo"}, "5x40"), ("job_items", {"state": "succeeded"}, "0+3x40")], 35,
     {"QueueStalled": False, "QueueBacklog": False}),
    ([("http_requests_total", {"route": "/s/:id/search", "status": "200"}, "0+60x20"), ("http_requests_total", {"route": "/s/:id/search", "status": "500"}, "0+30x20"),
      *[("http_request_duration_seconds_bucket", {"route": "/s/:id/search", "le": le}, v) for le, v in (("1", "0+10x20"), ("2.5", "0+20x20"), ("+Inf", "0+90x20"))],
      ("inference_busy", {}, "1x20"), ("inference_waiting", {}, "3x20")], 15,
     {"High5xxRate": True, "SlowSearch": True, "InferenceSaturated": True}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_operating_rules(spark, case):
    inputs, at, expected = CASES[case]
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), name, labels, v) for name, labels, spec in inputs for i, v in enumerate(series(spec))]
    metrics = spark.createDataFrame(rows, "ts timestamp_ntz, name string, labels map<string,string>, value double")
    wanted = {(k if isinstance(k, tuple) else (k, at)): v for k, v in expected.items()}
    rules = [r for r in OPERATING_RULES if r.name in {n for n, _ in wanted}]
    base = int(start.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
    got = {(r.rule, r.step - base): r.firing for r in evaluate_alerts(metrics, rules).collect()}
    assert {k: got.get(k, False) for k in wanted} == wanted


def test_rules_look_at_each_series(spark):
    """One of two instances down fires; three half-busy instances do not add up to a busy one."""
    start = dt.datetime(2024, 1, 1)
    samples = [("up", {"job": "api", "instance": "a"}, 1.0), ("up", {"job": "api", "instance": "b"}, 0.0),
               *[("inference_busy", {"instance": i}, 0.4) for i in "abc"], *[("inference_waiting", {"instance": i}, 2.0) for i in "abc"]]
    rows = [(start + dt.timedelta(minutes=m), name, labels, v) for name, labels, v in samples for m in range(30)]
    metrics = spark.createDataFrame(rows, "ts timestamp_ntz, name string, labels map<string,string>, value double")
    rules = [r for r in OPERATING_RULES if r.name in ("ApiDown", "InferenceSaturated")]
    firing = {(r.rule, r.series) for r in evaluate_alerts(metrics, rules).where("firing").collect()}
    assert firing == {("ApiDown", '{"instance":"b","job":"api"}')}


def test_windows_cross_blocks(spark):
    rows = spark.range(20_000).select(F.lit("x").alias("series"), (F.col("id") * 2).alias("step"), (F.col("id") % 7).alias("v"))
    got = trailing(rows, ["series"], 9, "s", lambda w: F.sum("v").over(w)).orderBy("step").collect()
    assert len(got) == 20_000 and all(r.s == sum((r.step // 2 - k) % 7 for k in range(5) if r.step // 2 >= k) for r in got)
