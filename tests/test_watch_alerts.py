"""Alert rules on a stream against the batch form on the same samples."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.streaming.alerts import Rule, Signal, evaluate_alerts
from seamark.streaming.watch_alerts import STATE_STORE, quantile, watch_alerts

RULES = [
    Rule("down", [(Signal("up", labels={"job": "api"}), "==", 0)], 1),
    Rule("stalled", [(Signal("queue", labels={"status": "todo"}, summed=True), ">", 0), (Signal("items", "delta", 3, summed=True), "==", 0)], 2),
    Rule("saturated", [(Signal("busy", "average", 3), ">", 0.5), (Signal("waiting", "average", 3), ">", 0.4)], 1),
    Rule("errors", [(Signal("requests", "rate", 4, {"status": "5.."}, summed=True), ">", 0.2)], 1, Signal("requests", "rate", 4, summed=True)),
    Rule("slow", [(Signal("seconds_bucket", "quantile", 3), ">", 1.0)], 1)]
SCHEMA = "ts timestamp, name string, labels map<string,string>, value double"


def samples(minutes: int):
    rng, rows, total = np.random.default_rng(5), [], {}
    start = dt.datetime(2024, 3, 1)
    for m in range(minutes):
        if m in (11, 12):  # nothing is measured
            continue
        at = lambda s=0: start + dt.timedelta(minutes=m, seconds=int(s))
        for job in ("api", "inference"):
            rows.append((at(5), "up", {"job": job}, 1.0))
            rows.append((at(40), "up", {"job": job}, float(rng.random() < 0.6)))
        for host in ("a", "b"):
            rows.append((at(10), "queue", {"status": "todo", "host": host}, float(rng.integers(0, 2))))
            rows.append((at(10), "items", {"state": "succeeded", "host": host}, float(m // 4)))
            rows.append((at(20), "busy", {"host": host}, float(rng.random())))
            if host == "a" or m % 3:
                rows.append((at(20), "waiting", {"host": host}, float(rng.random())))
        for status in ("200", "500", "503"):
            total[status] = 0.0 if (status, m) == ("500", 9) else total.get(status, 0.0) + float(rng.integers(0, 20))  # a restart
            rows.append((at(30), "requests", {"status": status}, total[status]))
        counts = np.sort(rng.integers(0, 10, 3)).tolist()
        for le, n in zip(("0.5", "2", "+Inf"), counts):
            total[le] = total.get(le, 0.0) + n
            rows.append((at(30), "seconds_bucket", {"le": le, "route": "x"}, total[le]))
        rows.append((at(1), "unused", {}, 1.0))
    return rows


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stream_equals_batch(spark, rocksdb):
    """Three deliveries; samples of a minute come in the wrong order and after those of the next."""
    rows, folder = samples(20), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    order = np.argsort([r[0].timestamp() + np.random.default_rng(6).uniform(0, 80) for r in rows], kind="stable")
    late = (rows[0][0] - dt.timedelta(days=1), "up", {"job": "api"}, 0.0)
    flush = (rows[-1][0] + dt.timedelta(days=1), "up", {"job": "api"}, 1.0)
    parts = [[rows[i] for i in order[:150]], [rows[i] for i in order[150:300]], [rows[i] for i in order[300:]] + [late], [flush], [flush]]
    query = None
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={n}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/part=*")
        query = watch_alerts(stream, RULES, 60, "3 minutes").writeStream.format("parquet").option("checkpointLocation", f"{folder}/mark").option(
            "path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    shape = lambda df: sorted((r.rule, r.series, r.step, None if r.value is None else round(r.value, 9), r.firing) for r in df.collect())
    got = shape(spark.read.parquet(f"{folder}/out"))
    want = shape(evaluate_alerts(spark.createDataFrame(rows, SCHEMA), RULES, 60))
    assert got == want and any(r[4] for r in got) and {r[0] for r in got} == {r.name for r in RULES}


@pytest.mark.parametrize("pairs, want", [([(1.0, 0.0), (float("inf"), 0.0)], None), ([(1.0, 10.0), (float("inf"), 10.0)], 0.95),
                                         ([(1.0, 5.0), (2.0, 10.0), (float("inf"), 10.0)], 1.9), ([(1.0, 1.0), (float("inf"), 10.0)], 1.0)])
def test_quantile(pairs, want):
    got = quantile(pairs, 0.95)
    assert got == want if want is None else abs(got - want) < 1e-12
