"""Each training-data operator on a small table with every odd case, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seamark.llm import common, decontamination, licenses, line_dedup, mpeg, near_texts, packing, sharding, simhash, token_store, toxicity, url_rules
from seamark.llm.common import shared_table
from seamark.llm.components import components
from seamark.llm.queries import vocabulary
from seamark.llm.tokens import Encoder

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{n}x" for n in range(400)]


def sentence(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ROWS = [
    (1, sentence(1, 60), "en"), (2, sentence(1, 60), "en"), (2, sentence(1, 60), "en"),  # a copy, and its row twice
    (3, None, None), (4, "", "fr"), (5, "  \n\t ", "xx"), (6, "one", "en"), (7, "Two\nWORDS ÉÀ", "de"),
    (8, sentence(8, 30_000), "en"),                                                     # long
    (9, sentence(1, 59) + " other", "en"), (None, sentence(10, 20), "en"), (11, "É " * 40, "fr"),
    (12, "a  b\n c   d 's <|endoftext|> 12", "en"), (13, "Under the MIT License. under the mit license", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(
        [(*r, f"s{k}", k, 0.5, True, "x", k) for k, r in enumerate(ROWS)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, toxic boolean, words string, tie int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def reference_ids(text, end):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_whole_texts():
    rng = np.random.default_rng(3)
    parts = ["a", "B", " ", "  ", "\n", "'s", "1", ".", "é", " the", "\t", " ", "!", "　", "😀", "\x1c"]
    t, e = tokenizer(), Encoder(vocabulary())
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_store(docs, empty, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 512)
    monkeypatch.setattr(token_store, "BUCKET", 4)
    store = token_store.write_store(docs, vocabulary(), shards=3)
    got = sorted(token_store.fetch(store, docs, "doc_id", with_ids=True).collect(), key=lambda r: r.start)
    assert len(got) == len(ROWS)
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = sorted(((k, reference_ids(x, 2).tobytes()) for k, x, _ in ROWS), key=str)
    assert sorted(((r.key, bytes(r.ids)) for r in got), key=str) == want
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    absent = docs.select((F.col("doc_id") + 1000).alias("key")).where("key is not null")
    assert token_store.fetch(store, absent).count() == 0
    nothing = token_store.write_store(empty, vocabulary())
    assert token_store.fetch(nothing, docs, "doc_id").count() == 0


def test_perfect_hash_is_minimal():
    keys = np.arange(5000) * 7919 - 10_000
    hashes = token_store.entry_hash(keys, np.zeros(len(keys), int))
    sizes, bits = token_store.build_levels(hashes)
    assert sorted(token_store.find_slots(hashes, sizes, bits)) == list(range(len(keys)))


def test_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 64)
    many = spark.createDataFrame([(7, f"text {k}") for k in range(60)] + [(k, "x") for k in range(5)], "doc_id bigint, text string")
    store = token_store.write_store(many, vocabulary(), shards=4)
    got = token_store.fetch(store, many, "doc_id").groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {7: 60, **{k: 1 for k in range(5)}}


def test_null_key_and_its_number_are_told_apart(spark):
    rows = [(token_store.NULL_KEY, "the number"), (None, "no key at all"), (3, "three")]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary())
    asked = lambda *keys: {r.key: bytes(r.ids) for r in token_store.fetch(
        store, spark.createDataFrame([(k,) for k in keys], "key bigint"), with_ids=True).collect()}
    want = {k: reference_ids(x, 2).tobytes() for k, x in rows}
    assert asked(3, None, token_store.NULL_KEY) == want
    assert asked(None) == {None: want[None]} and asked(token_store.NULL_KEY) == {token_store.NULL_KEY: want[token_store.NULL_KEY]}


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 40, 41, 1000])
def test_permutation(rows):
    out = sharding.permute(np.arange(rows), rows, 42)
    assert sorted(out) == list(range(rows))
    assert (sharding.permute(out, rows, 42, inverse=True) == np.arange(rows)).all()


def test_sharding(docs, empty):
    got = sharding.shard_rows(docs.select("doc_id", "tie"), ["doc_id", "tie"], 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(ROWS) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r.doc_id for r in sorted(got, key=lambda r: r.row_number)][0] is None
    assert sharding.shard_rows(empty.select("doc_id"), ["doc_id"], 4).count() == 0


def check_pieces(pieces, limits, rows, end=0):
    by_sequence, held = defaultdict(list), defaultdict(int)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length * 4 == len(p.ids)
        held[p.doc_id] += p.length
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(s) <= limits.segments and sum(p.loss_tokens for p in s) <= limits.loss
    want = defaultdict(int)
    for k, x, _ in rows:
        want[k] += len(reference_ids(x, end))
    assert held == want
    return by_sequence


def test_packing(docs, empty):
    pieces = packing.pack_documents(docs, vocabulary(), with_ids=True).collect()
    sequences = check_pieces(pieces, packing.Limits(), ROWS)
    assert all(n == 1024 or n & (n - 1) == 0 for n in (sum(p.length for p in s) for s in sequences.values()))
    whole = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == 8), key=lambda p: p.start))
    assert whole == reference_ids(ROWS[8][1], 0).tobytes()
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_packing_under_three_limits(spark):
    rows = [(k, sentence(k, 5 + k % 50), k % 3 > 0) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, loss boolean")
    limits = packing.Limits(tokens=512, segments=6, loss=300)
    check_pieces(packing.pack_documents(df, vocabulary(), limits=limits, with_ids=True, loss="loss").collect(), limits, rows)


def test_packing_without_cuts():
    packer, rng = packing.Packer(packing.Limits(100, 8, 60)), np.random.default_rng(5)
    items = [packing.Item(k, 0, int(n), int(n * f), cuttable=False) for k, (n, f) in enumerate(zip(rng.integers(1, 100, 500), rng.random(500) * 0.5))]
    out = list(itertools.chain.from_iterable(map(packer.add, items))) + list(packer.finish())
    assert sorted(i.owner for s in out for i in s) == list(range(500))
    assert all(sum(i.length for i in s) <= 100 and sum(i.loss for i in s) <= 60 and len(s) <= 8 for s in out)


def words3(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if x]
    return [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    fps = []
    for k, x, _ in ROWS:
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in words3(x)]
        fps.append((k, sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))))
    label = list(range(len(fps)))
    for _ in fps:
        for i, j in itertools.product(range(len(fps)), repeat=2):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                label[i] = label[j] = min(label[i], label[j])
    name = {c: min((fps[i][0] for i in range(len(fps)) if label[i] == c and fps[i][0] is not None), default=None) for c in set(label)}
    want = sorted(((k, f"{f:016x}", name[label[i]]) for i, (k, f) in enumerate(fps)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_vantage_trees_lose_no_pair(spark, slices):
    rng = np.random.default_rng(slices)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(2)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    got = {r.node: r.root for r in components(simhash.link_fingerprints(df, 3, slices, leaf=16)).collect()}
    u = fps.view(np.uint64)
    label = np.arange(len(u))
    while True:
        before = label.copy()
        for i in range(len(u)):
            close = np.bitwise_count(u ^ u[i]) <= 3
            label[close] = label[close].min()
        if (label == before).all():
            break
    groups = defaultdict(list)
    for x, c in zip(fps.tolist(), label):
        groups[c].append(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


def test_components_of_a_path(spark):
    links = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(n, 0) for n in range(501)}
    assert components(links.limit(0)).count() == 0


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def test_decontamination(spark, docs, empty):
    items = [(1, sentence(8, 30_000).split(" ", 100)[:100]), (2, ["one"]), (3, None), (4, []), (5, sentence(1, 60).split()[20:45]),
             (5, sentence(1, 60).split()[20:45]), (6, sentence(99, 30).split()), (7, ["Two", "words"]), (None, sentence(10, 20).split()[:12])]
    rows = [(k, None if w is None else ", ".join(w), "t") for k, w in items]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string, words string")
    got = decontamination.decontaminate(docs, benchmark).drop("tie").collect()
    want = []
    for k, x, _ in ROWS:
        w, hit, ids = split_words(x), set(), set()
        for item, text, _ in rows:
            b = split_words(text)
            for s in {tuple(b[i:i + min(10, len(b))]) for i in range(max(1, len(b) - 9))} if b else ():
                for i in range(len(w) - len(s) + 1):
                    if tuple(w[i:i + len(s)]) == s:
                        hit |= set(range(i, i + len(s)))
                        ids |= {str(item)} if item is not None else set()
        want.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.contaminated for r in got) >= 6
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, benchmark.limit(0)).collect())


def test_licenses(spark, docs, empty):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_documents(docs).collect()}
    r = got[13, 8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 0, 4, "mit", "mit", 1.0)
    assert got[3, 0].labels == "" and got[3, 0].score == 0.0 and len(licenses.scan_documents(docs).collect()) == len(ROWS)
    edited = ("x Permission is hereby granted, free of charge, to any kind person obtaining a copy of this lovely software and "
              "associated documentation files")
    again = " ".join(["permission is hereby granted"] * 6)  # the same four words are no notice, however often they stand
    more = spark.createDataFrame([(1, edited), (2, "permission is hereby granted to nobody"), (3, "cc by nc cc by nc"), (4, again)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.scan_documents(more).collect()}
    assert rows[1].labels == "mit" and rows[1].base_labels == "" and rows[1].n_base == 0 and rows[1].first_word is None
    assert rows[2].labels == "" and 0 < rows[2].score < licenses.COVER
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word) == (2, 0, 3)
    assert rows[4].labels == "" and abs(rows[4].score - 4 / 20) < 1e-9
    own = spark.createDataFrame([(7, "house", False, " ".join(f"clause{i}" for i in range(300)))], "template int, label string, phrase boolean, text string")
    long = spark.createDataFrame([(1, "so " + " ".join(f"clause{i}" for i in range(300) if i % 50))], "doc_id bigint, text string")
    (r,) = licenses.scan_documents(long, library=own).collect()
    assert r.labels == "house" and abs(r.score - 294 / 300) < 1e-9
    assert licenses.scan_documents(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 3)
    rng = np.random.default_rng(7)
    lines = set()
    for k in range(12):
        base = list("".join(rng.choice(list("abcdé "), rng.integers(38, 60))))
        for _ in range(14):
            x = base.copy()
            for _ in range(rng.integers(0, 4)):
                at, kind = rng.integers(0, len(x)), rng.integers(0, 3)
                x[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice(list("xyz"))]
            lines.add("".join(x))
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    near = line_dedup.near_lines(df)
    got = {r.line for r in df.join(near, F.xxhash64("line") == near["id"], "left_semi").collect()}
    long = [x for x in lines if len(x) >= line_dedup.NEAR_FROM]
    want = {a for a in long for b in long if (len(b), b.encode()) < (len(a), a.encode()) and edit_distance(a, b) <= 2}
    assert got == want and want


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_many_shared_segments_shuffle_no_text(spark, monkeypatch):
    lines = [sentence(k, 300) for k in range(300)]
    lines += [x[:-1] + "!" for x in lines[:20]] + [x[:-40] + sentence(k, 8) for k, x in enumerate(lines[20:60])]
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(4).cache()
    want = {tuple(r) for r in line_dedup.near_lines(df).collect()}
    monkeypatch.setattr(line_dedup, "SMALL", 10)
    for words in (1 << 20, 2):  # few and nearly all bits set
        monkeypatch.setattr(common, "SIEVE_WORDS", words)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            start = shuffled(spark)
            assert {tuple(r) for r in line_dedup.near_lines(df).collect()} == want and want
            taken = shuffled(spark) - start
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert words == 2 or taken < 2.5 * sum(map(len, lines)), taken  # every line under each of its twelve keys is more
    df.unpersist()


def test_many_shared_shingles_shuffle_only_what_meets(spark, monkeypatch):
    texts = [sentence(k, 400) for k in range(400)]
    texts += [x + " more" for x in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).cache()
    monkeypatch.setattr(near_texts, "SMALL", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled(spark)
        rows = near_texts.near_groups(df).collect()
        taken = shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        df.unpersist()
    group = {r.doc_id: r.group for r in rows}
    assert len(rows) == len(texts) and len(set(group.values())) == 400 and all(group[k] == group[400 + k] for k in range(30))
    assert taken < 5 * 16 * 80 * len(texts), taken  # with all first elements and whole sets shuffled again it is six and a half times that


def test_line_dedup(spark, docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_exact", "n_near"}
    rows = sorted(((r.source, r.text, r.n_lines, r.n_exact, r.n_near) for r in got.collect()), key=lambda r: int(r[0][1:]))
    assert rows[0][1:] == (ROWS[0][1], 1, 0, 0) and rows[1][1:] == ("", 1, 1, 0) == rows[2][1:]
    assert rows[3][1:] == (None, 0, 0, 0) and rows[4][1:] == ("", 1, 0, 0) and rows[5][1] == ROWS[5][1] and rows[8][1] == ROWS[8][1]
    assert len(rows) == len(ROWS)
    a, b = "The quick brown fox jumps over the lazy dog today", "The quick brown fox jumps over the lazy dogs today"
    more = spark.createDataFrame([(1, f"{a}\nshort\nshort\n{a}"), (2, f"{b}\nnew line that is long enough to be compared"), (None, a)], "doc_id bigint, text string")
    texts = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(more).collect()}
    assert texts == {None: (a, 1, 0, 0), 1: ("short\nshort", 4, 2, 0), 2: ("new line that is long enough to be compared", 2, 0, 1)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block"), ("a.b.net", "/fr/", "allow"), ("a.b.net", "/fr/", "block"), ("", "/x", "block")]
    urls = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://notexample.com/en/", "http://x.www.example.com/en/q?a#b",
            "http://com", "http://com?x/en/", "ftp://a.b.net/fr/é", "http://b.net/fr/", "http://net/es", "http://.net/es/x", "http://ÉX.com/", "nothing",
            "", None, "://", "http:///x", "http://a.net/fr/#://example.com/en/", "http://example.com/en/1", "http://example.com/en/1"]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(df, r).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.translate(UP)
        fit = sorted((len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and h)
        fit += [(2, "block", "/x")] if host == "" and path.startswith("/x") else []
        assert got[k] == (host, path, fit[-1][2] if fit else None, fit[-1][1] if fit else "allow"), u
    assert url_rules.judge(df.limit(0), r).count() == 0
    assert {x.verdict for x in url_rules.judge(df, r.limit(0), default="block").collect()} == {"block"}


def test_url_sweep_over_many_ranges(spark):
    hosts = [".".join(np.random.default_rng(k).choice(list("abc"), 1 + k % 4)) for k in range(200)]
    rules = sorted({(h, p, "block") for h in hosts[:60] for p in ("/", "/q")})
    df = spark.createDataFrame([(k, f"http://{h}/{'q' * (k % 3)}{k}") for k, h in enumerate(hosts * 3)], "page_id bigint, url string")
    got = {x.page_id: x.rule for x in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for k, h in enumerate(hosts * 3):
        fit = sorted(((len(r + p), r + p) for r, p, _ in rules if (h == r or h.endswith("." + r)) and f"/{'q' * (k % 3)}{k}".startswith(p)))
        assert got[k] == (fit[-1][1] if fit else None)


def test_mpeg_columns(docs, empty):
    stored = mpeg.encode_texts(docs)
    got = mpeg.read_media(stored).collect()
    want = []
    for k, x, _ in ROWS:
        raw = (x or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((k, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(" bad=0 skipped=0 " in r.feature and r.duration_samples == 1152 * len(r.frame_offsets) for r in got)
    assert mpeg.read_media(mpeg.encode_texts(empty)).count() == 0


def test_mpeg_parser_on_damage():
    payload = np.random.default_rng(1).integers(0, 256, 20_032, dtype=np.uint8).tobytes()
    clean = mpeg.mux(payload)
    s = mpeg.parse(clean)
    assert mpeg.payload_of(s) == payload and s.samples * 1000 == len(s.offsets) * 36 * s.rate and s.vbr["frames"] == len(s.offsets) and len(s.vbr["toc"]) == 100
    assert [mpeg.header(clean[o:o + 4]).length for o in s.offsets] == s.lengths and s.seek(0.04) == s.offsets[1] and s.seek(99) == s.offsets[-1]
    cut = clean[:s.offsets[3] + 7] + clean[s.offsets[5]:]                    # a frame and a half are gone
    damaged = mpeg.parse(cut)
    assert damaged.skipped > 0 and len(damaged.offsets) >= len(s.offsets) - 3
    broken = bytearray(clean)
    broken[s.offsets[2] + 8] ^= 1                                           # side information
    assert mpeg.parse(bytes(broken)).bad_checksums == 1
    with pytest.raises(ValueError):
        mpeg.payload_of(mpeg.parse(bytes(broken)))
    tagged = mpeg.parse(clean + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["TIT2"] == "Title" and tagged.skipped == 0
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 50).offsets == [] and mpeg.parse(bytes(500)).skipped == 500
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00))).length == 417       # 128 kbit/s at 44.1 kHz


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    bad = ["vilex", "fouly", "nastyz"]
    rows = []
    for k in range(600):
        w = list(rng.choice(WORDS, rng.integers(10, 60)))
        toxic = k % 6 == 0
        for _ in range(3 * toxic):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(bad)) + str(rng.choice(["", "a", "on"])))
        rows.append((k, " ".join(w), ("en", "fr")[k % 2], int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.fit(df, labels.where(~toxicity.held_out(F.col("doc_id"))))
    held = toxicity.score(df, model).where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert ((held.score >= 0.3) == (held.y == 1)).mean() > 0.95
    odd = toxicity.score(docs, model, keep_text=True)
    assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "tie", "score", "threshold", "toxic"]
    scores = {r.source: r.score for r in odd.collect()}
    assert len(scores) == len(ROWS) and all(0 <= v <= 1 for v in scores.values()) and scores["s0"] == pytest.approx(scores["s2"], abs=1e-6)
    assert scores["s3"] == pytest.approx(scores["s4"], abs=1e-6)
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(df, labels.where("toxic = 0"))
    assert {round(r.score, 3) for r in toxicity.score(docs, blank).collect()} == {0.0}
    assert toxicity.score(docs, toxicity.fit(df.limit(0), labels.limit(0))).count() == len(ROWS)


def test_thresholds_cover_all_labelled_rows(spark):
    """Caps of the classifier's sample change neither the share of toxic rows nor the rows that thresholds are taken from."""
    rng, rows = np.random.default_rng(6), []
    for k in range(1500):
        toxic, lang = k % 10 == 0, "fr" if k % 40 < 2 else "en"
        noisy = k % 10 and k % 12 == 1
        w = [*rng.choice(WORDS, 20), *["vilex"] * toxic, *["vilex"] * noisy]
        rows.append((k, " ".join(w), lang, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"))
    m = toxicity.fit(df, labels, max_positive=60, max_negative=80)
    scores = toxicity.score(df, m).toPandas()
    # Half of what says "vilex" is toxic, so F1 is best where those rows are flagged; too few toxic French rows are in the sample.
    assert set(m.thresholds) == {"en", "fr"}
    known = scores.merge(labels.toPandas().rename(columns={"toxic": "y_"}), on="doc_id")
    for lang, threshold in [*m.thresholds.items(), (None, m.fallback)]:
        rows = known if lang is None else known[known.lang == lang]
        f1 = lambda t: 2 * ((rows.score >= t) & (rows.y_ == 1)).sum() / max(1, (rows.score >= t).sum() + (rows.y_ == 1).sum())
        assert f1(threshold) >= max(f1(t) for t in rows.score) - 0.03


def test_threshold_by_counts_stands_for_trained_rows():
    counts = pd.DataFrame([("en", 1, True, 0, 900), ("en", 1, False, 300, 80), ("en", 1, False, -100, 20), ("en", 0, False, -100, 50),
                           ("en", 0, False, -400, 850), ("fr", 1, False, 200, 9), ("fr", 0, False, -200, 500)], columns=["lang", "y", "trained", "bin", "n"])
    m = toxicity.Model.new(np.random.default_rng(0))
    toxicity.set_thresholds(m, counts)
    edge = lambda b: 1 / (1 + np.exp(-b * toxicity.STEP))
    # 1,000 toxic rows, of which 200 lie in a bin with 50 clean ones: flagging that bin is better only with the trained rows' weight.
    assert m.thresholds == {"en": pytest.approx((edge(-100) + edge(-399)) / 2)}


def test_scores_do_not_depend_on_stretches(monkeypatch):
    m = toxicity.Model.new(np.random.default_rng(4))
    rng = np.random.default_rng(5)
    lengths = [0, 1, 5, 900, 0, 33, 2, 0]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    w, p = rng.integers(0, toxicity.BUCKETS, bounds[-1]), rng.integers(0, toxicity.BUCKETS, bounds[-1])
    whole = m.score(w, p, bounds)
    monkeypatch.setattr(toxicity, "SPAN", 64)
    assert np.allclose(whole, m.score(w, p, bounds), atol=1e-6)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_groups(rows):
    """Per row the smallest place reachable through pairs with 5-word Jaccard >= 0.8; rows without words stay alone."""
    sets, label = [shingles(x) for x in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def near_rows():
    """Copies with words changed at spread places, around the similarity 0.8, and one family larger than a cell."""
    rng, rows = np.random.default_rng(11), [x for _, x, _ in ROWS if x is None or len(x) < 9999]
    for k in range(60):
        base = sentence(100 + k, int(rng.integers(3, 200))).split()
        for _ in range(3):
            x = base.copy()
            for at in rng.integers(0, len(x), max(1, int(len(x) * rng.choice([0.01, 0.02, 0.04])))):
                x[at] = f"new{rng.integers(0, 10 ** 6)}"
            rows.append(" ".join(x))
    base = sentence(999, 150).split()
    return rows + [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in range(0, 150, 4)]


def test_near_groups_against_brute_force(spark, near_rows):
    df = spark.createDataFrame(list(enumerate(near_rows)), "doc_id bigint, text string")
    want = similar_groups(near_rows)
    for cell, frequent, family in ((8, 1_000_000, 2), (256, 0, 5), (256, 40, 1000), (64, 1_000_000, 32)):
        groups = defaultdict(list)
        for r in near_texts.near_groups(df, cell=cell, most_frequent=frequent, family=family).collect():
            groups[r.group if r.group is not None else f"none{r.doc_id}"].append(r.doc_id)
        assert {k: min(g) for g in groups.values() for k in g} == dict(enumerate(want)) and len(set(want)) < len(want)
    assert near_texts.near_groups(df.limit(0)).count() == 0


def test_boilerplate_families_are_not_compared(spark):
    """Texts that share half of their words are no candidates once what many share comes last."""
    shared = sentence(50, 100)
    rows = [(k, f"{shared} {' '.join(f'own{k}x{i}' for i in range(100))}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "doc_id", F.lit(0).cast("bigint").alias("tie"), F.col("text").cast("binary").alias("text"))
    frequent, counts = near_texts.frequent_elements(df, 5, 1000)
    assert len(frequent) == len(counts) == 96 and counts.min() > 150
    by_hash = near_texts._sets(df, lambda s: s[:near_texts.first_ones(len(s), (4, 5))], 5)
    firsts = near_texts._sets(df, lambda s: near_texts.first_elements(s, frequent, counts, (4, 5)), 5)
    assert near_texts.candidates(by_hash)[0].count() > 190
    assert [t.count() for t in near_texts.candidates(firsts)] == [0, 0]


def test_near_groups_go_through_fingerprints(spark, monkeypatch):
    """Long copies that differ in a word are found by SimHash alone, and only pairs that are similar enough are linked."""
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words[::-1]), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [near_texts.shingle_set(x.encode(), 5) for x in texts]
    fps = np.array([near_texts.fingerprint_of(s) for s in sets]).view(np.uint64)
    assert np.bitwise_count(fps[0] ^ fps[1]) <= near_texts.RADIUS < np.bitwise_count(fps[0] ^ fps[2])
    marked = near_texts._sets(df.select("doc_id", F.lit(0).cast("bigint").alias("tie"), F.col("text").cast("binary")), lambda s: s[:0], 5, fingerprint=True)
    nodes = [near_texts.node_of(s) for s in sets]
    assert [(r.u, r.v) for r in near_texts.fingerprint_pairs(marked).collect()] == [tuple(sorted(nodes[:2]))]
    monkeypatch.setattr(near_texts, "first_elements", lambda s, *_: s[:0])  # nothing left to prefix filtering
    groups = {r.doc_id: r.group for r in near_texts.near_groups(df).collect()}
    assert groups[0] == groups[1] != groups[2] and groups[3] is None
    unlike = spark.createDataFrame([(nodes[0], 1), (nodes[2], 1)], "node bigint, fp bigint")  # equal fingerprints, other texts
    monkeypatch.setattr(near_texts, "fingerprint_pairs", lambda firsts: unlike.select(F.lit(min(nodes[0], nodes[2])).alias("u"), F.lit(max(nodes[0], nodes[2])).alias("v")).limit(1))
    monkeypatch.setattr(near_texts, "delete_table", lambda table: None)
    groups = {r.doc_id: r.group for r in near_texts.near_groups(df).collect()}
    assert len(set(groups.values())) == 4


def test_near_dedup_stage_finds_similarity_of_four_fifths(spark, near_rows):
    """Most of these copies differ in more than three bits of their fingerprints."""
    rows = [(k, x, "en", "s", 1) for k, x in enumerate(near_rows) if shingles(x)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    label = similar_groups([r[1] for r in rows])
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == [rows[i][0] for i in sorted(set(label))]


def test_near_dedup_stage_tells_rows_apart_by_text(spark):
    """Ids that two texts share, copies without an id, repeated rows, texts without words."""
    a, b, c = sentence(1, 60), sentence(2, 60), sentence(3, 60)
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, None), (4, None), (4, None), (5, ""), (6, " "), (None, None), (7, "once"), (7, "again")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    want = {(1, a), (2, b), (None, c), (3, None), (4, None), (5, ""), (6, " "), (None, None), (7, "once"), (7, "again")}
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_stage_on_short_items(spark, tmp_path):
    """A word or two of a short item take no document out; a full window, or a text that is mostly short items, do."""
    common, answer, item = sentence(5, 2), "forty two is the answer", sentence(6, 14)
    spark.createDataFrame([(1, common), (2, answer), (3, item), (4, WORDS[0])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{sentence(20, 40)} {common} {WORDS[0]} {sentence(21, 40)}"), (2, f"{answer} {answer} or not"), (3, f"so {item[:item.rindex(' ')]} {sentence(22, 90)}"),
            (4, f"{sentence(23, 30)} {answer}"), (None, answer), (5, None), (5, common), (5, sentence(24, 30))]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()}
    assert got == {rows[i] for i in (0, 3, 5, 7)}


def test_stages_keep_wordless_texts_and_other_tables(spark, tmp_path):
    """Labels that are all toxic take out no text without words; line dedup needs no n_chars."""
    rows = [(k, x) for k, x in enumerate([None, "", " \n ", *(sentence(70 + k, 12) for k in range(40))])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    spark.createDataFrame([(k, 1, 1) for k, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {0, 1, 2} <= {r.doc_id for r in kept.collect()}
    out = corpus_pipeline.drop_lines(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang"] and out.count() == len(rows)


def plain_score(m, text):
    """The score of a text by loops over its words, windows, filters and components."""
    words = split_words(text)
    bucket = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    number = lambda w: bucket(w) % toxicity.BUCKETS
    rows = [[float(a) + float(b) for a, b in zip(m.words[number(w)], m.prefixes[number(w[:toxicity.PREFIX])])] for w in words]
    logit, k = float(m.offset), 0
    for width, weight in zip(toxicity.WIDTHS, m.filters):
        for f in range(toxicity.FILTERS):
            best = max((sum(rows[i + j][d] * float(weight[j][d][f]) for j in range(width) if i + j < len(rows) for d in range(toxicity.DIM))
                        for i in range(len(rows))), default=0.0)
            logit += max(best + float(m.bias[k]), 0.0) * float(m.dense[k])
            k += 1
    return 1 / (1 + np.exp(-(m.scale * logit + m.shift)))


def test_scores_against_loops(spark):
    """Words shared, repeated and cut short, empty and null texts; the threshold of a row's language decides."""
    rng = np.random.default_rng(21)
    m = toxicity.Model.new(rng)
    m.bias, m.offset, m.scale, m.shift = rng.normal(0, 0.2, m.bias.shape).astype(np.float32), 0.3, 1.7, -0.4
    m.thresholds, m.fallback = {"en": 0.2, "fr": 0.9}, 0.5
    texts = ["", None, "one", "One one ONE", "ab abcd abcde", *(sentence(300 + k, 1 + 5 * k) for k in range(8))]
    df = spark.createDataFrame([(k, x, ("en", "fr", "xx", None)[k % 4]) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string")
    for r in toxicity.score(df, m).collect():
        want, limit = plain_score(m, texts[r.doc_id] or ""), {"en": 0.2, "fr": 0.9}.get(r.lang, 0.5)
        assert abs(r.score - want) < 1e-4 and r.threshold == limit and r.toxic == (r.score >= limit)
