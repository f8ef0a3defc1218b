import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.operators.embedding import HashEmbedder
from seamark.operators.stores import members_direct
from seamark.operators.vector_search import search_exact
from seamark.profiles import PROFILES
from seamark.sources.catalog import Catalog
from seamark.sources.files import gate_files, scan_corpus, verify_checksums
from seamark.streaming.ingest import stream_ingest
from seamark.streaming.liveness import watch_sources
from seamark.streaming.metering import months_of, rate_windows, usage_days

PLANS = ("workspace_id string, plan struct<name:string,allow_excess:boolean,limits:struct<storage_bytes:bigint,"
         "index_tokens_month:bigint,query_tokens_month:bigint,requests_per_minute:int>,features:map<string,boolean>>")


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def streamed(spark, parts, schema, build, mode="append"):
    """Feed the parts one after another and return all rows the stream gave."""
    source, sink, mark = fresh(), fresh() + "/out", fresh()
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        (build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet")
         .outputMode(mode).option("checkpointLocation", mark).option("path", sink).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(sink)


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute, seconds=second)


def test_request_windows_stream_equals_batch(spark):
    schema = "workspace_id string, principal string, at timestamp"
    rows = [("w", "hot" if i % 3 else f"p{i % 5}", at(i % 6, i % 60)) for i in range(120)]
    plans = spark.createDataFrame([("w", ("p", False, (1, 1, 1, 10), {}))], PLANS)
    late = [("w", "end", at(300))]
    got = streamed(spark, [rows[:60], rows[60:], late, late], schema, lambda s: rate_windows(s, plans)).where("principal <> 'end'")
    want = rate_windows(spark.createDataFrame(rows, schema), plans)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    busy = want.where("principal = 'hot'").first()
    assert busy.allowed == min(busy.hits, 10) and busy.refused == max(busy.hits - 10, 0)


def test_usage_is_counted_once(spark):
    schema = "workspace_id string, kind string, quantity long, idem_key string, created_at timestamp"
    day = lambda n: dt.datetime(2024, 1, n, 12)
    first = [("w", "a", 5, "k1", day(1)), ("w", "a", 5, "k1", day(1)), ("w", "b", 2, "k2", day(2))]
    second = [("w", "a", 5, "k1", day(1)), ("w", "a", 7, "k3", day(2))]
    close = [("w", "z", 1, "k9", day(20))]
    got = streamed(spark, [first, second, close, [("w", "z", 1, "k10", day(25))]], schema, usage_days).where("kind <> 'z'")
    assert {(r.kind, str(r.month.date())): r.quantity for r in months_of(got).collect()} == {("a", "2024-01-01"): 12, ("b", "2024-01-01"): 2}
    table = usage_days(spark.createDataFrame(first + second, schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, table.collect()))


def test_source_falls_silent(spark):
    schema = "source string, at timestamp"
    one = [("a", at(0)), ("b", at(0))]
    two = [("a", at(0, 25)), ("a", at(0, 50))]
    three = [("a", at(1, 10))]
    got = streamed(spark, [one, two, three, [("a", at(1, 12))]], schema, watch_sources).collect()
    assert [(r.source, r.last_beat) for r in got] == [("b", at(0))]


def test_catalog_publishes_atomically(spark):
    catalog = Catalog(spark, fresh() + "/cat")
    rows = spark.createDataFrame([("w1", "s1", "k", 1), ("w2", "s2", "k", 2)], "workspace_id string, store_id string, name string, x int")
    assert catalog.read("stores", "w1").count() == 0
    catalog.publish("stores", rows)
    assert [r.store_id for r in catalog.read("stores", "w1").collect()] == ["s1"]
    assert catalog.read("stores", None).count() == 0 and catalog.read("stores", "").count() == 0
    staged = catalog.stage("stores", rows)  # not visible before its pointer
    assert catalog.read_all("stores").count() == 2
    catalog.flip("stores", [staged], 1)
    with pytest.raises(Exception):  # a second writer that saw pointer 1
        catalog.flip("stores", [staged], 1)
    catalog.append("stores", rows.where("store_id = 's1'"))
    assert catalog.read("stores", "w1").count() == 2
    file = spark.createDataFrame([("w1", "f1", "a", "v1", "2024-01-01 00:00:00")], "workspace_id string, file_id string, path string, current_version_id string, updated_at string")
    catalog.append("files", file)
    catalog.append("files", file.withColumn("current_version_id", F.lit("v2")).withColumn("updated_at", F.lit("2024-01-02 00:00:00")))
    assert [r.current_version_id for r in catalog.read("files", "w1").collect()] == ["v2"]
    catalog.compact("files")
    assert len(catalog.state("files")[1]) == 1 and catalog.read("files", "w1").first().current_version_id == "v2"


def write(folder, name, data):
    import pathlib
    target = pathlib.Path(folder) / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def test_scan_gate_verify(spark):
    folder = fresh()
    for name, data in {"a/x.txt": b"hello", "a/.hidden/y.txt": b"no", "b.exe": b"no", "empty.md": b"", "c.MD": b"# T"}.items():
        write(folder, name, data)
    files = scan_corpus(spark, folder)
    good, bad = gate_files(files, 1000)
    assert {r.path: r.media_type for r in good.collect()} == {"a/x.txt": "text/plain", "c.MD": "text/markdown"}
    reasons = {r.path: r.reason for r in bad.collect()}
    assert reasons == {"b.exe": "unsupported format"}  # empty and hidden files are not even scanned
    listing = spark.createDataFrame([("empty.md", 0), ("a/.git/x.txt", 5), ("../x.txt", 1), ("e\u0301.txt", 1), ("big.md", 2000), ("a//b.md", 1)], "path string, size long")
    good2, bad2 = gate_files(listing, 1000)
    assert {r.path: r.reason for r in bad2.collect()} == {"empty.md": "empty file", "a/.git/x.txt": "hidden", "../x.txt": "unsafe path", "big.md": "too large", "a//b.md": "unsafe path"}
    assert [r.path for r in good2.collect()] == ["\u00e9.txt"]
    manifest = good.select(F.col("path").alias("file_id"), "size", F.sha2("content", 256).alias("sha256"))
    assert {r.outcome for r in verify_checksums(good.select(F.col("path").alias("file_id"), "content"), manifest).collect()} == {"VERIFIED"}


def test_continuous_ingest(spark):
    folder, catalog, mark = fresh(), Catalog(spark, fresh() + "/cat"), fresh()

    def run():
        stream_ingest(spark, folder, catalog, "w", "s", PROFILES["p3"], lambda: HashEmbedder(32), mark).awaitTermination()

    write(folder, "docs/a.md", b"# Pump\n\nPrime the pump. Check the seal.\n")
    write(folder, "docs/b.txt", b"Belts need tension.")
    write(folder, "docs/bad.txt", b"\xff\xfe\xfa")
    run()
    files = {r.path: r for r in catalog.read("files", "w").collect()}
    assert set(files) == {"docs/a.md", "docs/b.txt"} and all(r.current_version_id for r in files.values())
    first = catalog.read("segments", "w").count()
    assert first == 2
    write(folder, "docs/copy/b.txt", b"Belts need tension.")  # same bytes and name: vectors are copied
    run()
    segments = catalog.read("segments", "w")
    twins = segments.where("content like 'Belts%'").collect()
    assert segments.count() == 3 and len({r.segment_id for r in twins}) == 2 and twins[0].embedding == twins[1].embedding
    assert catalog.read("store_files", "w").count() == 3 and catalog.read("file_versions", "w").count() == 3
    stores = spark.createDataFrame([("s", "material", None)], "store_id string, kind string, deleted_at string")
    members = members_direct(stores, catalog.read("store_files", "w"), catalog.read("files", "w"), catalog.read("file_versions", "w"))
    assert members.count() == 3
    vector, _ = HashEmbedder(32).embed(["Prime the pump."])
    asked = spark.createDataFrame([("q", [float(x) for x in vector[0]])], "query_id string, embedding array<float>")
    best = search_exact(asked, segments, 1).join(segments, "segment_id").first()
    assert best.content.startswith("# Pump\nPrime")


def test_redelivered_batch_adds_nothing(spark):
    from seamark.streaming.ingest import ingest_batch
    catalog = Catalog(spark, fresh() + "/cat")
    arrived = spark.createDataFrame([("a.txt", 5, b"Hello"), ("b.exe", 5, b"x"), ("c.txt", 3, b"\xff\x00a")], "path string, size long, content binary")
    for _ in range(2):
        out = {r.path: r.outcome for r in ingest_batch(catalog, arrived, "w", "s", PROFILES["p1"], lambda: HashEmbedder(8)).collect()}
    assert out == {"a.txt": "succeeded", "b.exe": "unsupported format", "c.txt": "UNREADABLE"}
    assert [catalog.read(t, "w").count() for t in ("files", "file_versions", "segments", "store_files")] == [1, 1, 1, 1]
    changed = spark.createDataFrame([("a.txt", 7, b"Changed")], "path string, size long, content binary")
    ingest_batch(catalog, changed, "w", "s", PROFILES["p1"], lambda: HashEmbedder(8))
    assert [catalog.read(t, "w").count() for t in ("files", "file_versions", "segments", "store_files")] == [1, 2, 2, 1]
    newest = catalog.read("file_versions", "w").where("version_no = 2").first().version_id
    assert catalog.read("files", "w").first().current_version_id == newest


def test_deliveries_of_one_path_are_folded(spark):
    """Repeated and out-of-order revisions, in one batch and over batches, publish the newest once; usage is charged once."""
    from seamark.streaming.ingest import ingest_batch
    catalog, at = Catalog(spark, fresh() + "/cat"), lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "path string, size long, modified_at timestamp, content binary"
    run = lambda rows: sorted((r.path, r.outcome) for r in ingest_batch(
        catalog, spark.createDataFrame(rows, schema), "w", "s", PROFILES["p1"], lambda: HashEmbedder(8)).collect())
    first = run([("a.txt", 3, at(5), b"new"), ("a.txt", 3, at(5), b"new"), ("a.txt", 3, at(2), b"old"), ("b.txt", 1, at(1), b"b")])
    assert first == [("a.txt", "succeeded"), ("a.txt", "superseded"), ("b.txt", "succeeded")]
    assert [catalog.read(t, "w").count() for t in ("files", "file_versions", "segments")] == [2, 2, 2]
    assert run([("a.txt", 4, at(3), b"late")]) == [("a.txt", "superseded")]
    assert run([("a.txt", 3, at(5), b"new")]) == [("a.txt", "succeeded")]
    assert run([("a.txt", 6, at(9), b"newest"), ("a.txt", 3, at(7), b"new")]) == [("a.txt", "succeeded"), ("a.txt", "superseded")]
    assert {r.content for r in catalog.read("segments", "w").collect()} == {"new", "b", "newest"}
    current = {r.current_version_id for r in catalog.read("files", "w").collect()}
    assert {r.content for r in catalog.read("segments", "w").collect() if r.version_id in current} == {"b", "newest"}
    usage = catalog.read("usage_events", "w").collect()
    assert len(usage) == 3 and len({u.idem_key for u in usage}) == 3 and all(u.quantity > 0 for u in usage)
    states = {r.item_id.split("|")[1]: 0 for r in catalog.read("job_items", "w").collect()}
    assert set(states) == {"a.txt", "b.txt"} and catalog.read("job_items", "w").where("state <> 'succeeded'").count() == 0


def test_broken_vectors_are_not_published(spark):
    from seamark.streaming.ingest import ingest_batch

    class Broken:
        dims = 4

        def embed(self, texts):
            return np.array([[float("nan") if "bad" in t else 1.0] * 4 for t in texts], np.float32), [1] * len(texts)

    catalog = Catalog(spark, fresh() + "/cat")
    arrived = spark.createDataFrame([("a.txt", 3, b"bad"), ("b.txt", 4, b"good")], "path string, size long, content binary")
    out = {r.path: r.outcome for r in ingest_batch(catalog, arrived, "w", "s", PROFILES["p1"], Broken).collect()}
    assert out == {"a.txt": "NON_FINITE_EMBEDDING", "b.txt": "succeeded"} and catalog.read("segments", "w").count() == 1
    assert {r.path: r.error_code for r in catalog.read("job_items", "w").collect()} == {"a.txt": "NON_FINITE_EMBEDDING", "b.txt": None}


def test_ingest_serves_modalities_or_says_so(spark):
    from seamark.streaming.ingest import ingest_batch
    arrived = spark.createDataFrame([("x.png", 3, b"png"), ("a.txt", 5, b"Hello"), ("only.md", 6, b"# Only"), ("p.pdf", 3, b"pdf")],
                                    "path string, size long, content binary")
    text_only = Catalog(spark, fresh() + "/cat")
    out = {r.path: r.outcome for r in ingest_batch(text_only, arrived, "w", "s", PROFILES["p3"], lambda: HashEmbedder(8)).collect()}
    assert out == {"x.png": "FORMAT_UNSUPPORTED", "a.txt": "succeeded", "only.md": "EMPTY_CONTENT", "p.pdf": "FORMAT_UNSUPPORTED"}
    assert text_only.read("files", "w").count() == 1

    def decode(sources):
        pdf = sources.where("media_type = 'application/pdf'")
        return {"pages": pdf.selectExpr("version_id as doc_id", "1 as page", "'A page of text.' as text", "cast(null as string) as ocr_text")}

    both = Catalog(spark, fresh() + "/cat")

    class Pictures:  # a model of images, whose input has no text
        dims = 8

        def embed(self, texts):
            return np.ones((len(texts), 8), np.float32), [1] * len(texts)

    makers = {"text": lambda: HashEmbedder(8), "image": Pictures}
    out = {r.path: r.outcome for r in ingest_batch(both, arrived, "w", "s", PROFILES["p3"], makers, decode).collect()}
    assert out == {"x.png": "succeeded", "a.txt": "succeeded", "only.md": "EMPTY_CONTENT", "p.pdf": "succeeded"}
    segments = both.read("segments", "w")
    assert {r.modality for r in segments.collect()} >= {"text", "image"} and segments.where("embedding is null").count() == 0
