import uuid

from pyspark.sql import functions as F

from seamark.functions.ids import SEGMENT_NAMESPACE, uuid5
from seamark.operators.embedding import (HashEmbedder, embed, reuse_by_content, reuse_by_preparation, validate_vectors)
from seamark.operators.lifecycle import check_replay, publish, replay_ledger, resolve_versions, retry_plan
from seamark.operators.paging import decode_cursor, encode_cursor, next_cursor, page
from seamark.operators.prepare import check_budget, model_inputs
from seamark.operators.retention import collect_blobs, collect_versions
from seamark.operators.statistics import finalize_jobs
from seamark.profiles import PROFILES


def test_uuid5_equals_python(spark):
    names = [f"v{i}:p{i % 3}:{i}" for i in range(200)] + ["ünïcode:p:0"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", uuid5(F.col("n"), SEGMENT_NAMESPACE).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.UUID(SEGMENT_NAMESPACE), r.n))


def test_resolution_order_and_numbers(spark):
    files = spark.createDataFrame([("f1", "a.txt", "v1", None), ("f2", "b.txt", "v2", "2024-01-01"), ("f3", "c.txt", "v3", None)],
                                  "file_id string, path string, current_version_id string, deleted_at string")
    versions = spark.createDataFrame([("v1", "f1", 1, "h1"), ("v1b", "f1", 2, "h1b"), ("v2", "f2", 1, "h2"), ("v3", "f3", 1, "h3")],
                                     "version_id string, file_id string, version_no int, sha256 string")
    held = spark.createDataFrame([("s", "f1"), ("s", "f2"), ("s", "f3")], "store_id string, file_id string")
    rows = [("i1", "s", None, "u1", "a.txt", "h1"), ("i2", "s", None, "u2", "a.txt", "new"), ("i3", "s", None, "u3", "a.txt", "other"),
            ("i4", "s", None, "u4", "b.txt", "h2"), ("i5", "s", "f2", "u5", "b.txt", "h2"), ("i6", "s", None, "u6", "zzz.txt", "x"),
            ("i7", "t", None, "u7", "q.txt", "x"), ("i8", "s", "f3", "u8", "a.txt", "h3")]
    incoming = spark.createDataFrame([(*r, 1, "text/plain") for r in rows], "item_id string, store_id string, file_id string, "
                                     "upload_id string, path string, sha256 string, size long, media_type string")
    earlier = spark.createDataFrame([("u7", "f1")], "upload_id string, file_id string")
    got = {r.item_id: r for r in resolve_versions(incoming, files, versions, held, earlier).collect()}
    action = {k: (r.action, r.version_no) for k, r in got.items()}
    assert action == {"i1": ("reuse", None), "i2": ("new_version", 3), "i3": ("new_version", 4), "i4": ("new_file", 1),
                      "i5": ("NOT_FOUND", None), "i6": ("new_file", 1), "i7": ("new_version", 5), "i8": ("reuse", None)}
    assert got["i1"].version_id == "v1" and got["i7"].file_id == "f1" and got["i4"].file_id not in ("f1", "f2", "f3")


def test_older_version_never_replaces_newer(spark):
    files = spark.createDataFrame([("f1", "v2", None), ("f2", None, None), ("f3", "w1", "2024-01-01"), ("f4", "x1", None)],
                                  "file_id string, current_version_id string, deleted_at string")
    versions = spark.createDataFrame([("v1", 1), ("v2", 2), ("u1", 1), ("u2", 2), ("w1", 1), ("w2", 2), ("x1", 1), ("x2", 2)],
                                     "version_id string, version_no int")
    batch = spark.createDataFrame([("f1", "v1"), ("f2", "u1"), ("f2", "u2"), ("f3", "w2"), ("f4", "x2")], "file_id string, version_id string")
    assert {r.file_id: r.current_version_id for r in publish(files, versions, batch).collect()} == {
        "f1": "v2", "f2": "u2", "f3": "w1", "f4": "x2"}


def test_job_states(spark):
    cases = {"none": [], "ok": ["succeeded"], "mixed": ["succeeded", "failed"], "bad": ["failed"], "cx": ["succeeded", "cancelled"],
             "open": ["succeeded", "queued"], "fresh": ["queued"]}
    jobs = spark.createDataFrame([(k, "queued") for k in cases] + [("done", "failed"), ("stop", "cancel_requested")], "job_id string, state string")
    items = spark.createDataFrame([(k, s, True) for k, v in cases.items() for s in v] + [("done", "succeeded", True), ("stop", "succeeded", True)],
                                  "job_id string, state string, retryable boolean")
    assert {r.job_id: r.state for r in finalize_jobs(jobs, items).collect()} == {
        "none": "completed", "ok": "completed", "mixed": "completed_with_errors", "bad": "failed", "cx": "cancelled",
        "open": "running", "fresh": "queued", "done": "failed", "stop": "cancelled"}


def test_garbage_keeps_what_is_needed(spark):
    """A blob awaited by a queued import stays, so do current, pinned and in-flight versions."""
    files = spark.createDataFrame([("f1", "v2", None), ("f2", "d1", "2024-01-01")], "file_id string, current_version_id string, deleted_at string")
    versions = spark.createDataFrame([("w", v, f, s, c) for v, f, s, c in [
        ("v1", "f1", "a", "2024-01-01"), ("v2", "f1", "b", "2024-01-01"), ("pin", "f1", "c", "2024-01-01"), ("fly", "f1", "d", "2024-01-01"),
        ("young", "f1", "e", "2024-06-01"), ("d1", "f2", "a2", "2024-06-01")]],
        "workspace_id string, version_id string, file_id string, sha256 string, created_at string")
    held = spark.createDataFrame([("s", "f1", None), ("p", "f1", "pin"), ("p", "f2", "d1")], "store_id string, file_id string, pinned_version_id string")
    items = spark.createDataFrame([("fly", "running"), ("v1", "failed")], "version_id string, state string")
    cutoff = F.lit("2024-03-01")
    removed = collect_versions(versions, files, held, items, cutoff)
    assert {(r.version_id, r.reason) for r in removed.collect()} == {("v1", "superseded"), ("d1", "source deleted")}
    blobs = spark.createDataFrame([("w", s, "2024-06-01" if s == "new" else "2024-01-01") for s in "a b c d e a2 wait new".split()],
                                  "workspace_id string, sha256 string, created_at string")
    pending = spark.createDataFrame([("w", "wait")], "workspace_id string, sha256 string")
    assert {r.sha256 for r in collect_blobs(blobs, versions, removed, pending, cutoff).collect()} == {"a", "a2"}


def test_ledger_keeps_the_first_time(spark):
    files = spark.createDataFrame([("f1", None), ("f2", "2024-01-01"), ("f3", None), ("f4", None)], "file_id string, deleted_at string")
    stores = spark.createDataFrame([("s1", None), ("s2", None)], "store_id string, deleted_at string")
    held = spark.createDataFrame([("s1", "f1"), ("s2", "f2")], "store_id string, file_id string")
    ledger = spark.createDataFrame([("file.delete", "f1", "2024-03-02", None), ("file.delete", "f1", "2024-03-03", None),
                                    ("file.delete", "f2", "2024-03-02", None), ("store.delete", "s1", "2024-03-04", ["f3"]),
                                    ("file.delete", "f4", "2024-02-01", None)], "kind string, id string, at string, file_ids array<string>")
    after = replay_ledger(files, stores, held, ledger, F.lit("2024-03-01"))
    assert {r.file_id: r.deleted_at for r in after["files"].collect()} == {"f1": "2024-03-02", "f2": "2024-01-01", "f3": "2024-03-04", "f4": None}
    assert {r.store_id: r.deleted_at for r in after["stores"].collect()} == {"s1": "2024-03-04", "s2": None}
    assert {r.store_id for r in after["store_files"].collect()} == {"s2"}


def test_replay_and_retry(spark):
    requests = spark.createDataFrame([("k", 1, "r1", "x"), ("k", 2, "r2", "x"), ("k", 3, "r3", "y"), ("l", 1, "r4", None), ("l", 2, "r5", "y")],
                                     "idem_key string, at int, request_id string, body string")
    assert {r.idem_key: (r.request_id, r.replayed, r.conflicts) for r in check_replay(requests, ["body"]).collect()} == {
        "k": ("r1", 1, 1), "l": ("r4", 0, 1)}
    jobs = spark.createDataFrame([("j1", "failed", "ingest"), ("j2", "running", "ingest")], "job_id string, state string, kind string")
    items = spark.createDataFrame([("j1", "a", "failed", True), ("j1", "b", "failed", False), ("j1", "c", "succeeded", False), ("j2", "d", "failed", True)],
                                  "job_id string, item_id string, state string, retryable boolean").withColumn(
        "path", F.col("item_id")).withColumn("file_id", F.col("item_id")).withColumn("version_id", F.col("item_id"))
    assert [r.item_id for r in retry_plan(jobs, items).collect()] == ["a"]


def test_pages_are_exact_to_the_microsecond(spark):
    rows = [("2024-01-01 00:00:00.000001", "a"), ("2024-01-01 00:00:00.000002", "b"), ("2024-01-01 00:00:00.000002", "c"), ("2024-01-01 00:00:00", "d")]
    df = spark.createDataFrame(rows, "t string, id string").select(F.col("t").cast("timestamp_ntz").alias("created_at"), "id")
    seen, after = [], None
    for _ in range(10):
        found = page(df, 1, after).collect()
        seen.append(found[0].id)
        cursor = next_cursor(found, 1)
        if cursor is None:
            break
        after = decode_cursor(cursor)
    assert seen == ["c", "b", "a", "d"] and decode_cursor(encode_cursor("x", "y")) == ("x", "y")


def test_vectors_are_checked(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("ok", [3.0, 4.0]), ("short", [1.0]), ("nan", [nan, 1.0]), ("inf", [inf, 1.0]), ("zero", [0.0, 0.0]), ("null", None)],
                               "id string, embedding array<float>")
    got = {r.id: (r.error_code, r.embedding) for r in validate_vectors(df, 2).collect()}
    assert got["ok"][0] is None and [round(x, 6) for x in got["ok"][1]] == [0.6, 0.8]
    assert {k: v[0] for k, v in got.items() if k != "ok"} == {"short": "DIMENSION_MISMATCH", "null": "DIMENSION_MISMATCH",
                                                             "nan": "NON_FINITE_EMBEDDING", "inf": "NON_FINITE_EMBEDDING", "zero": "NON_FINITE_EMBEDDING"}


SEGMENTS = ("segment_id string, version_id string, profile_id string, ordinal int, modality string, token_count int, embedding array<float>")


def test_reuse(spark):
    versions = spark.createDataFrame([("v1", "h", "a.png", "image/png"), ("v2", "h", "a.png", "image/png"), ("v3", "h", "b.png", "image/png"),
                                      ("v4", "t", "t.txt", "text/plain")], "version_id string, sha256 string, filename string, media_type string")
    segments = spark.createDataFrame([("s", "v1", "p1", 0, "image", 5, [1.0]), ("s4", "v4", "p1", 0, "text", 5, [2.0])], SEGMENTS)
    wanted = versions.select("version_id")
    copied = reuse_by_content(wanted, versions, segments, "p1").collect()
    assert [(r.version_id, r.source_version) for r in copied] == [("v2", "v1")]
    assert copied[0].segment_id == str(uuid.uuid5(uuid.UUID(SEGMENT_NAMESPACE), "v2:p1:0")) and copied[0].embedding == [1.0]
    profiles = spark.createDataFrame([("p1", "m", "r", "f", {"image": "280", "text": "x"}), ("p2", "m", "r", "f", {"image": "280", "text": "x"}),
                                      ("p3", "m", "r2", "f", {"image": "280"}), ("p4", "m", "r", "f", {"image": "560"})],
                                     "profile_id string, model string, revision string, dtype string, preparation map<string,string>")
    same = {p: [r.version_id for r in reuse_by_preparation(wanted, versions, segments, profiles, p).collect()] for p in ("p2", "p3", "p4")}
    assert same == {"p2": ["v1"], "p3": [], "p4": []}


def test_embedding_job(spark):
    df = spark.createDataFrame([(i, f"word{i % 5} and word{i % 3}") for i in range(100)] + [(100, None)], "id int, input string").repartition(4)
    rows = embed(df, lambda: HashEmbedder(16)).collect()
    direct, tokens = HashEmbedder(16).embed(["word2 and word2"])
    mine = [r for r in rows if r.id == 2][0]
    assert len(rows) == 101 and mine.embedding == [float(x) for x in direct[0]] and mine.token_count == tokens[0] == 3


def test_inputs_and_budget(spark):
    segments = spark.createDataFrame([("v1", "S | T", 3, "body {title}"), ("v1", None, None, None)],
                                     "version_id string, section string, page int, content string")
    versions = spark.createDataFrame([("v1", "m.pdf")], "version_id string, filename string")
    rows = model_inputs(segments, versions, PROFILES["p3"]).collect()
    assert {r.input for r in rows} == {"title: m.pdf › S / T · p. 3 | text: body {title}", None}
    over = check_budget(spark.createDataFrame([("a b c",), ("a b",)], "input string"), limit=2).collect()
    assert [(r.tokens, r.error_code) for r in over] == [(3, "INPUT_TOO_LARGE"), (2, None)]
