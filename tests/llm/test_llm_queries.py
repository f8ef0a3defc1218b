"""The registered training-data queries over whole tables: against their SQL, or against brute force."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F
from test_llm_texts import edit_distance, reference_ids, similar_groups, split_words, words3

import corpus_pipeline
from seamark.llm import line_dedup, toxicity
from seamark.llm.common import shared_table, table
from seamark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, SF_DIR, QUERIES, ORACLES) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_token_store(spark, texts):
    got, at = {r.doc_id: r for r in QUERIES["op1_token_store"](spark, SF_DIR).collect()}, 0
    assert len(got) == len(texts)
    for k, x in texts:
        ids = reference_ids(x, 2)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sharding(spark, texts):
    got, shards = QUERIES["op3_shard"](spark, SF_DIR).collect(), defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == [k for k, _ in texts] and len(shards) == 40
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and len({len(v) for v in shards.values()}) <= 2
    sizes = {k: (len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for k, x in texts}
    assert all((r["size"], r.text_crc32) == sizes[r.doc_id] for r in got)


def test_packing(spark, texts):
    pieces, sequences, want = defaultdict(list), defaultdict(list), {k: reference_ids(x, 0) for k, x in texts}
    for r in QUERIES["op4_pack"](spark, SF_DIR).collect():
        pieces[r.doc_id].append(r), sequences[r.sequence_id].append(r)
    for k, ids in want.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lengths = [sum(r.length for r in s) for s in sequences.values()]
    assert max(lengths) <= 1024 and sum(1024 - n for n in lengths if n & (n - 1)) < 0.01 * sum(lengths)


def test_mpeg(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_mpeg"](spark, SF_DIR).collect()}
    for k, x in texts:
        raw = (x or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[k].payload_sha256, got[k].tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == len(texts)


def components_of(rows):
    """{doc_id: smallest reachable} by 3-word SimHash within 3 bits."""
    import xxhash
    fps = []
    for _, x in rows:
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in words3(x)]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    u, label = np.array(fps, np.uint64), np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(u ^ f) <= 3) for f in u]
    while True:
        before = label.copy()
        for js in near:
            label[js] = label[js].min()
        if (label == before).all():
            break
    first = defaultdict(lambda: np.inf)
    for (k, _), c in zip(rows, label):
        first[c] = min(first[c], k)
    return {k: (f"{f:016x}", first[c]) for (k, _), f, c in zip(rows, fps, label)}


def test_simhash(spark, texts):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, SF_DIR).collect()} == components_of(texts)


def test_toxicity(spark, texts):
    got = QUERIES["op2_toxicity"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in texts]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_on_held_out_labels(spark):
    """At a scale with enough labels the held-out ones are told apart."""
    big = SF_DIR.replace("0.001", "0.1")
    held = QUERIES["op2_toxicity"](spark, big).drop("toxic").where("held_out").join(table(spark, big, "labels"), "doc_id").toPandas()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.95 and held[held.toxic == 1].predicted.mean() > 0.8


def near_copies(rows):
    """Lines that go as near copies, by comparing all pairs of about the same length."""
    by = defaultdict(set)
    for _, x in rows:
        for line in (x or "").split("\n"):
            if len(line) >= line_dedup.NEAR_FROM:
                by[len(line)].add(line)
    out = set()
    for n, lines in by.items():
        for a, m in itertools.product(lines, range(n - 2, n + 1)):
            for b in by.get(m, ()):
                if (len(b), b.encode()) < (len(a), a.encode()) and any(s in a for s in (b[:m // 3], b[m // 3:m // 3 * 2], b[-(m // 3):])):
                    if edit_distance(a, b) <= 2:
                        out.add(a)
    return out


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version on the rows that the stage before it kept."""
    docs = table(spark, SF_DIR, "documents")
    labels, columns = table(spark, SF_DIR, "labels"), docs.columns
    clean = [f"plain{k % 97}word" for k in range(0, 900, 7)]
    near, far = [w if k != 60 else "another" for k, w in enumerate(clean)], [w if k % 9 else "else" for k, w in enumerate(clean)]
    passage = " ".join(f"calm{k}" for k in range(60)) + " " + table(spark, SF_DIR, "benchmark").orderBy("item_id").first().text
    planted = [(10 ** 6 + k, x, "en", "src0", len(x)) for k, x in enumerate([" ".join(clean), " ".join(near), " ".join(clean), passage, " ".join(far)])]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
        out = shared_table(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        got = {r.doc_id: r for r in out.collect()} if name != "packing" else out.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
            assert set(got) == {r.doc_id for r in toxicity.score(docs, model).where("not toxic").collect()}
        elif name == "line dedup":
            near, seen, want = near_copies(given), set(), {}
            for k, x in given:
                kept, lost = [], False
                for line in x.split("\n"):
                    goes = len(line) >= line_dedup.EXACT_FROM and (line in seen or line in near)
                    seen.add(line)
                    kept, lost = (kept, True) if goes else (kept + [line], lost)
                if not lost or "\n".join(kept).strip(" "):
                    want[k] = "\n".join(kept)
            assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near-dedup":
            assert set(got) == {given[i][0] for i in set(similar_groups([x for _, x in given]))}
            assert not {10 ** 6 + 1, 10 ** 6 + 2} & set(got) and {10 ** 6, 10 ** 6 + 3} <= set(got)
        elif name == "benchmark decontamination":
            grams = set()
            for r in table(spark, SF_DIR, "benchmark").collect():
                w = split_words(r.text)
                grams |= {tuple(w[i:i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
            clean = set()
            for k, x in given:
                w = split_words(x)
                found = [(i, n) for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in grams]
                short = {j for i, n in found if n < 10 for j in range(i, i + n)}
                if not any(n == 10 for _, n in found) and not (short and 2 * len(short | {j for i, n in found for j in range(i, i + n)}) >= len(w)):
                    clean.add(k)
            assert 10 ** 6 + 3 not in clean
            assert set(got) == clean
        else:
            ids = defaultdict(bytes)
            for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
                ids[r.doc_id] += bytes(r.ids)
            assert dict(ids) == {k: reference_ids(x, 0).tobytes() for k, x in given}
        if name != "packing":
            assert out.columns == columns and 0 < len(got) <= len(given)
        docs = out


def test_pipeline_on_odd_rows(spark):
    """Null and empty texts, repeated rows, null ids, clashing columns, an empty table."""
    rows = [(1, None), (2, ""), (3, "a word or two"), (3, "a word or two"), (None, "no id here"), (5, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 0.5, True, 9) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, toxic boolean, n_lines int")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = shared_table(stage(spark, given, SF_DIR), name.replace(" ", "-"))
            if name != "packing":
                assert out.columns == docs.columns and out.schema["toxic"].dataType == docs.schema["toxic"].dataType
                given = out
    assert out.count() == 0
