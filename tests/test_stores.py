import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from seamark.functions.metadata import compact_chars, contains, merge_patch, stored_bytes, typed_metadata
from seamark.functions.text import slug
from seamark.operators.lifecycle import delete_files, promotable, promote, unshared_sources
from seamark.operators.stores import (merge_report, merge_stores, resolve_all, snapshot, split_by_field)
from seamark.operators.store_changes import applied, candidates_of, member_changes, propagate
from seamark.operators.stores import members_direct
from seamark.schemas import STORE_DEFINITION
from seamark.sources.export import export_segments

STORES = ("store_id string, name string, kind string, definition " + STORE_DEFINITION.simpleString()
          + ", deleted_at string, active_revision_id string")


class World:
    """A small catalogue as plain rows, with a recursive membership function to compare with."""

    def __init__(self, spark, stores, files, versions, memberships):
        self.rows = {s[0]: s for s in stores}
        self.file_rows, self.version_rows, self.membership_rows = {f[0]: f for f in files}, {v[0]: v for v in versions}, memberships
        self.stores = spark.createDataFrame([(*s, "r") for s in stores], STORES)
        self.files = spark.createDataFrame(files, "file_id string, path string, current_version_id string, metadata map<string,string>, deleted_at string")
        self.versions = spark.createDataFrame(versions, "version_id string, file_id string, version_no int, media_type string, sha256 string")
        self.store_files = spark.createDataFrame(memberships, "store_id string, file_id string, pinned_version_id string")

    def resolved(self):
        return resolve_all(self.stores, self.store_files, self.files, self.versions)

    def expected(self, store):
        _, _, kind, definition, deleted = self.rows[store]
        if deleted:
            return {}
        if kind != "view":
            out = {}
            for s, f, pin in self.membership_rows:
                version = pin or self.file_rows[f][2]
                if s == store and not self.file_rows[f][4] and version:
                    out[f] = version
            return out
        parents, (meta, prefix, kinds), _ = definition
        best = {}
        for parent in dict.fromkeys(parents):
            for f, v in self.expected(parent).items():
                _, path, _, metadata, _ = self.file_rows[f]
                if any(metadata.get(k) != x for k, x in (meta or {}).items()) or (prefix and not path.startswith(prefix)):
                    continue
                if kinds is not None and self.version_rows[v][3] not in kinds:
                    continue
                if f not in best or self.version_rows[v][2] > self.version_rows[best[f]][2]:
                    best[f] = v
        return best


def random_world(spark, seed):
    rng = random.Random(seed)
    files = [(f"f{i}", f"{rng.choice('ab')}/{i}.txt", None if rng.random() < .1 else f"v{i}-{1 + i % 2}",
              {"d": rng.choice(['"x"', '"1"', "1"])}, "2024-01-01" if rng.random() < .1 else None) for i in range(120)]
    versions = [(f"v{i}-{n}", f"f{i}", n, rng.choice(["text/plain", "image/png"]), f"h{i}-{n}") for i in range(120) for n in (1, 2)]
    stores = [(f"m{i}", f"m{i}", "material", None, "2024-01-02" if i == 3 else None) for i in range(4)]
    stores.append(("snap", "snap", "snapshot", None, None))
    names = [s[0] for s in stores]
    for depth in (1, 2, 3):
        for j in range(3):
            parents = rng.sample(names, 3)
            f = (rng.choice([None, {}, {"d": '"x"'}, {"d": "1"}]), rng.choice([None, "a/"]), rng.choice([None, ["text/plain"]]))
            stores.append((f"v{depth}{j}", f"v{depth}{j}", "view", (parents, f, depth), "2024-01-02" if (depth, j) == (1, 2) else None))
        names = [s[0] for s in stores]
    members = [(f"m{0 if rng.random() < .5 else rng.randrange(4)}", f"f{i}", None) for i in range(120)]
    members += [("snap", f"f{i}", f"v{i}-1") for i in range(0, 120, 3)]
    return World(spark, stores, files, versions, members)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_membership_equals_recursion(spark, seed):
    world = random_world(spark, seed)
    got = {(r.store_id, r.file_id): r.version_id for r in world.resolved().collect()}
    want = {(s, f): v for s in world.rows for f, v in world.expected(s).items()}
    assert got == want and any(s.startswith("v3") for s, _ in want)


def test_merge_counts(spark):
    """References 5, memberships 3, duplicates 2."""
    stores = [("A", "A", "material", None, None), ("B", "B", "material", None, None), ("C", "C", "material", None, None)]
    files = [("f1", "shared/ppe", "v1", {}, None), ("f2", "a/lathe", "v2", {}, None), ("f3", "b/weld", "v3", {}, None)]
    versions = [(f"v{i}", f"f{i}", 1, "text/plain", f"h{i}") for i in (1, 2, 3)]
    world = World(spark, stores, files, versions, [("A", "f1", None), ("A", "f2", None), ("B", "f1", None), ("B", "f2", None), ("B", "f3", None)])
    segments = spark.createDataFrame([(f"v{i}", "p") for i in (1, 2, 3)], "version_id string, profile_id string")
    members = world.resolved()
    r = merge_report(members, world.stores, segments, ["A", "B"], "p").first()
    assert (r.source_references, r.memberships, r.duplicates_removed) == (5, 3, 2)
    partial = segments.where("version_id <> 'v2'")
    assert merge_stores(members, world.stores, partial, ["A", "B"], "T", "p").count() == 2


def test_snapshot_keeps_old_versions_until_deletion(spark):
    stores = [("m", "m", "material", None, None), ("v", "v", "view", (["m"], ({}, None, None), 1), None), ("s", "s", "snapshot", None, None)]
    files = [("f1", "a", "v1", {}, None), ("f2", "b", "v2", {}, None)]
    versions = [("v1", "f1", 1, "text/plain", "h"), ("v1b", "f1", 2, "text/plain", "i"), ("v2", "f2", 1, "text/plain", "j")]
    world = World(spark, stores, files, versions, [("m", "f1", None), ("m", "f2", None)])
    frozen = snapshot(world.resolved(), "v", "s")
    newer = world.files.withColumn("current_version_id", F.when(F.col("file_id") == "f1", "v1b").otherwise(F.col("current_version_id")))
    held = world.store_files.unionByName(frozen)
    got = {(r.store_id, r.file_id): r.version_id for r in resolve_all(world.stores, held, newer, world.versions).collect()}
    assert got[("s", "f1")] == "v1" and got[("v", "f1")] == "v1b"
    gone = delete_files(newer, spark.createDataFrame([("f1",)], "file_id string"), F.lit("2024-02-01"))
    left = {(r.store_id, r.file_id) for r in resolve_all(world.stores, held, gone, world.versions).collect()}
    assert left == {("m", "f2"), ("v", "f2"), ("s", "f2")}
    assert {r.file_id for r in unshared_sources(world.store_files, world.stores, world.files, "m").collect()} == {"f1", "f2"}


def test_split(spark):
    stores = [("m", "m", "material", None, None), ("x", "Base-HR", "material", None, None)]
    values = ['"service"', '"hr"', '"Ops & Planning"', "1", '"1"', "[1]", "null", "true"]
    files = [(f"f{i}", f"p{i}", f"v{i}", {"dep": v}, None) for i, v in enumerate(values)]
    versions = [(f"v{i}", f"f{i}", 1, "text/plain", f"h{i}") for i in range(len(values))]
    world = World(spark, stores, files, versions, [("m", f"f{i}", None) for i in range(len(values))])
    got = {r.value: (r.name, r.outcome) for r in split_by_field(world.resolved(), world.stores, "m", "dep", "base").collect()}
    assert got == {"service": ("base-service", "created"), "hr": ("base-hr", "name exists"), "1": ("base-1", "created"),
                   "Ops & Planning": ("base-ops-planning", "created"), "true": ("base-true", "created")}
    few = split_by_field(world.resolved(), world.stores, "m", "dep", "base", max_splits=2)
    assert {r.outcome for r in few.collect()} == {"too many values"}


def test_typed_metadata(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "1", "c": true, "d": 1.0}',)], "j string").select(typed_metadata(F.col("j")).alias("m"))
    checks = {"a1": {"a": 1}, "a1.0": {"a": 1.0}, "b": {"b": "1"}, "d": {"d": 1}, "none": {}, "not a": {"a": "1"}, "not b": {"b": 1},
              "not x": {"x": 1}, "not c": {"c": "true"}}
    row = df.select(*[contains(F.col("m"), f).alias(n) for n, f in checks.items()]).first().asDict()
    assert row == {n: not n.startswith("not") for n in checks}
    one = df.select(compact_chars(F.col("m")).alias("c"), stored_bytes(F.col("m")).alias("s")).first()
    assert (one.c, one.s) == (len('{"a":1,"b":"1","c":true,"d":1}'), len('{"a": 1, "b": "1", "c": true, "d": 1}'))
    patched = df.select(merge_patch(F.col("m"), F.create_map(F.lit("a"), F.lit("null"), F.lit("e"), F.lit("2"))).alias("m")).first().m
    assert patched == {"b": '"1"', "c": "true", "d": "1", "e": "2"}


def test_slug(spark):
    cases = {"Ops & Planning": "ops-planning", "---": "empty", "Café №1": "cafe-o1", "x" * 80: "x" * 60}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r.v: r.s for r in df.select("v", slug(F.col("v")).alias("s")).collect()} == cases


def test_promotion_and_rollback(spark):
    revisions = spark.createDataFrame([("r1", "s", "p1", "active"), ("r2", "s", "p2", "ready"), ("r3", "s", "p3", "ready"), ("r4", "s", "p4", "building")],
                                      "revision_id string, store_id string, profile_id string, state string")
    members = spark.createDataFrame([("s", "v1"), ("s", "v2")], "store_id string, version_id string")
    segments = spark.createDataFrame([(v, p) for v, p in itertools.product(("v1", "v2"), ("p1", "p2"))] + [("v1", "p3")],
                                     "version_id string, profile_id string")
    assert {r.revision_id: (r.missing, r.verdict) for r in promotable(revisions, members, segments).collect()} == {
        "r1": (0, "active"), "r2": (0, "promotable"), "r3": (1, "INDEX_INCOMPLETE"), "r4": (2, "INDEX_NOT_READY")}
    stores = spark.createDataFrame([("s", "r1")], "store_id string, active_revision_id string")
    after, store, outcome = promote(revisions, stores, promotable(revisions, members, segments), ["r2"])
    assert [tuple(r) for r in outcome.collect()] == [("r2", "active")]
    assert {r.revision_id: r.state for r in after.collect()} == {"r1": "ready", "r2": "active", "r3": "ready", "r4": "building"}
    assert store.first().active_revision_id == "r2"
    for refused, code in (("r3", "INDEX_INCOMPLETE"), ("r4", "INDEX_NOT_READY")):
        same, unmoved, outcome = promote(after, store, promotable(after, members, segments), [refused])
        assert sorted(map(tuple, same.collect())) == sorted(map(tuple, after.collect()))
        assert unmoved.first().active_revision_id == "r2" and outcome.first().outcome == code
    back, store, _ = promote(after, store, promotable(after, members, segments), ["r1"])
    assert {r.revision_id: r.state for r in back.collect()}["r1"] == "active" and store.first().active_revision_id == "r1"


def test_changes_carried_through_views_equal_resolving_again(spark):
    """Rounds of deletions, new pointers, metadata and memberships; what is kept beside the members goes on to the next round."""
    from seamark.session import cut_lineage
    old = random_world(spark, 3)
    views = old.stores.where("deleted_at is null and kind = 'view'")
    rows = lambda df: {(r.store_id, r.file_id, r.version_id, r.path, tuple(sorted(r.metadata.items()))) for r in df.collect()}
    members, candidates = cut_lineage(old.resolved()), cut_lineage(candidates_of(views, old.resolved()))
    rng = random.Random(4)
    for _ in range(3):
        files, held = [list(f) for f in old.file_rows.values()], list(old.membership_rows)
        for f in rng.sample(files, 12):
            change = rng.randrange(4)
            f[2] = rng.choice([None, f"v{f[0][1:]}-1", f"v{f[0][1:]}-2"]) if change == 0 else f[2]
            f[3] = {"d": rng.choice(['"x"', "1"])} if change == 1 else f[3]
            f[4] = ("2024-02-01" if f[4] is None else None) if change == 2 else f[4]
            f[1] = "a/moved" + f[0] if change == 3 else f[1]
        held = [m for m in held if rng.random() > 0.03]
        free = {(s, f[0]) for s, *_ in old.rows.values() for f in files if old.rows[s][2] == "material"} - {m[:2] for m in held}
        held += [(*m, None) for m in rng.sample(sorted(free), 5)]
        new = World(spark, list(old.rows.values()), [tuple(f) for f in files], list(old.version_rows.values()), held)
        direct = lambda w: members_direct(w.stores, w.store_files, w.files, w.versions)
        changes = member_changes(direct(old), direct(new))
        delta, given = propagate(changes, candidates, views)
        members, candidates = cut_lineage(applied(members, delta)), cut_lineage(applied(candidates, given))
        assert rows(members) == rows(new.resolved()) and members.where("n <> 1").isEmpty()
        counts = lambda df: {(r.store_id, r.file_id, r.version_id, r.facts_id, r.n) for r in df.collect()}
        assert counts(candidates) == counts(candidates_of(views, new.resolved()))
        old = new
    assert propagate(changes.limit(0), candidates, views)[0].isEmpty()


def test_export_shuffles_text_once(spark, capsys):
    """However many stores show a version: its text goes through one exchange, before it is repeated for each of them."""
    members = spark.createDataFrame([("a", "f1", "v1"), ("b", "f1", "v1"), ("b", "f2", "v2")], "store_id string, file_id string, version_id string")
    files = spark.createDataFrame([("f1", "a/1.txt", {"lang": "en"}), ("f2", "b/2.txt", {})], "file_id string, path string, metadata map<string,string>")
    versions = spark.createDataFrame([("v1", 1, "1.txt", "text/plain", "h1"), ("v2", 3, "2.txt", "text/plain", "h2")],
                                     "version_id string, version_no int, filename string, media_type string, sha256 string")
    segments = spark.createDataFrame([("v1", "s1", "p1", 0, "text", 1, None, "one", [1.0]), ("v2", "s2", "p1", 0, "text", 1, None, "two", [2.0])],
                                     "version_id string, segment_id string, profile_id string, ordinal int, modality string, token_count int, "
                                     "location struct<page:int>, content string, embedding array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = export_segments(members, segments, files, versions)
        capsys.readouterr()
        rows.explain("formatted")
        nodes = capsys.readouterr().out.split("\n\n")
        got = sorted((r.store_id, r.segment_id, r.content, r.source.path, r.source.version_no, r.source.sha256) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [n for n in nodes if re.search(r"\) Exchange\n", n)]
    assert len(exchanges) > 2 and sum("content#" in n for n in exchanges) == 1
    assert got == [("a", "s1", "one", "a/1.txt", 1, "h1"), ("b", "s1", "one", "a/1.txt", 1, "h1"), ("b", "s2", "two", "b/2.txt", 3, "h2")]


def test_members_delta_reads_versions_once(spark):
    """However many levels of views a change goes through, the versions (whose hashes take the whole text) are worked out once."""
    from seamark.plans.bindings import Tables
    from seamark.plans.stores import members_delta
    t, seen = Tables(spark, "/root/testdata/sf0.001"), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        seen.add(1)
        return n

    n = t.versions.count()
    t.__dict__["versions"] = t.versions.withColumn("version_no", counted("version_no"))
    assert members_delta(t).count() > 0 and n <= seen.value <= 2 * n
