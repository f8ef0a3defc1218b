import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions.text import identifiers
from seamark.operators.ann import MIN_LIST, build_index, list_size, load_index, search_lists
from seamark.operators.evaluation import compare_runs, eval_answers, eval_hits, eval_recall
from seamark.operators.evidence import build_context, evidence
from seamark.operators.filters import Filter
from seamark.operators.hybrid import interleave, search_balanced, search_hybrid
from seamark.operators.keyword import search_keyword, selective_terms
from seamark.operators import term_index, vector_search
from seamark.operators.term_index import open_term_index
from seamark.operators.vector_search import eligible, search_exact

DIMS = 8


def vectors(n, seed=1):
    return np.random.default_rng(seed).normal(size=(n, DIMS)).astype(np.float32)


def frame(spark, ids, matrix, key, **extra):
    rows = [(i, [float(x) for x in v], *[extra[c][n] for c in extra]) for n, (i, v) in enumerate(zip(ids, matrix))]
    schema = f"{key} string, embedding array<float>" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame(rows, schema)


def brute(queries, stored, qids, sids, k, keep=None):
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    distance = np.round(1 - unit(queries) @ unit(stored).T, 12)
    out = set()
    for q, row in zip(qids, distance):
        order = sorted((d, s) for s, d in zip(sids, row) if keep is None or s in keep)
        out |= {(q, s, n) for n, (_, s) in enumerate(order[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Two thousand segments of which a third are copies of one vector, so that ties matter."""
    matrix = vectors(2000)
    matrix[::3] = matrix[0]
    ids = [f"s{(i * 7919) % 2000:05d}" for i in range(2000)]
    modality = [("text", "image", "audio")[i % 3] for i in range(2000)]
    return matrix, ids, modality, frame(spark, ids, matrix, "segment_id", modality=modality).repartition(6)


@pytest.mark.parametrize("shipped", [4096, 0])
def test_exact_equals_brute_force(spark, corpus, monkeypatch, shipped):
    matrix, ids, _, segments = corpus
    asked = np.concatenate([vectors(20, 2), matrix[:1]])
    qids = [f"q{i}" for i in range(21)]
    if shipped == 0:  # small cells, so the grid has many
        monkeypatch.setattr(vector_search, "CELL_QUERIES", 4)
        monkeypatch.setattr(vector_search, "CELL_SEGMENTS", 150)
    got = {(r.query_id, r.segment_id, r["rank"]) for r in search_exact(
        frame(spark, qids, asked, "query_id"), segments, 7, max_shipped=shipped).collect()}
    assert got == brute(asked, matrix, qids, ids, 7)


def test_top_k_per_modality(spark, corpus):
    matrix, ids, modality, segments = corpus
    asked = vectors(5, 3)
    qids = [f"q{i}" for i in range(5)]
    rows = search_exact(frame(spark, qids, asked, "query_id"), segments, 4, group="modality").collect()
    for kind in ("text", "image", "audio"):
        keep = {s for s, m in zip(ids, modality) if m == kind}
        assert {(r.query_id, r.segment_id, r["rank"]) for r in rows if r.modality == kind} == brute(asked, matrix, qids, ids, 4, keep)
    best = search_balanced(frame(spark, qids, asked, "query_id"), segments, 6, ["text", "image", "audio"]).collect()
    for q in qids:
        mine = sorted((r["rank"], r.modality_rank) for r in best if r.query_id == q)
        assert [m for _, m in mine] == [1, 1, 1, 2, 2, 2]


def nested(n, seed=11):
    """Vectors in clouds of clouds: lists with small radii, as real embeddings have."""
    rng = np.random.default_rng(seed)
    tops = rng.normal(size=(12, DIMS))
    subs = tops[rng.integers(0, 12, 60)] + 0.2 * rng.normal(size=(60, DIMS))
    return (subs[rng.integers(0, 60, n)] + 0.03 * rng.normal(size=(n, DIMS))).astype(np.float32)


def test_lists_follow_the_table(spark, corpus):
    _, _, _, segments = corpus
    index = build_index(segments, size=100)
    sizes = sorted(index.sizes.tolist())
    assert sum(sizes) == 2000 and sizes[-1] >= 667 and sizes[-2] <= 100  # copies of one vector stay together
    assert min(s for s in sizes if s) > 1 and index.levels <= 20
    rows = index.rows.collect()
    assert len({r.segment_id for r in rows}) == 2000
    for r in rows:
        x = np.array(r.embedding, float)
        assert np.linalg.norm(x / np.linalg.norm(x) - index.centroids[r.list]) <= index.radii[r.list] + 1e-9
    assert list_size(100, 8) == MIN_LIST and list_size(10 ** 10, 768) * 4_000_000 >= 10 ** 10 * 768


def test_probes_by_bound_are_exact_when_certified(spark, corpus):
    for matrix, ids in ((corpus[0], corpus[1]), (nested(3000), [f"n{i}" for i in range(3000)])):
        segments = frame(spark, ids, matrix, "segment_id").repartition(5)
        asked = np.concatenate([vectors(12, 4), matrix[:6]])
        qids = [f"q{i}" for i in range(len(asked))]
        queries, want = frame(spark, qids, asked, "query_id"), brute(asked, matrix, qids, ids, 10)
        index = build_index(segments, size=60)
        whole = search_lists(queries, index, 10, probes=2).collect()
        assert {(r.query_id, r.segment_id, r["rank"]) for r in whole} == want and all(r.certified for r in whole)
        part = search_lists(queries, index, 10, probes=2, limit=6).collect()
        sure = {r.query_id for r in part if r.certified}
        assert {(r.query_id, r.segment_id, r["rank"]) for r in part if r.certified} == {w for w in want if w[0] in sure}
        assert all(sum(r.query_id == q for r in part) == 10 for q in qids)
    assert sure  # clouds of clouds are certified without all lists


def test_recall_of_a_limited_search(spark):
    """Questions are all vectors whose number is divisible by 100."""
    matrix = nested(4000, 12)
    segments = frame(spark, [f"n{i}" for i in range(4000)], matrix, "segment_id")
    asked = frame(spark, [f"q{i}" for i in range(0, 4000, 100)], matrix[::100], "query_id")
    index = build_index(segments)
    recall = eval_recall(search_lists(asked, index, 10, probes=4, limit=len(index.sizes) // 4), search_exact(asked, segments, 10), 10)
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9


def test_filter_fills_k_from_lists(spark, monkeypatch):
    from seamark.operators import ann
    monkeypatch.setattr(ann, "SHIPPED_QUERIES", 4)  # several blocks of questions
    matrix = nested(2500, 13)
    ids, shelf = [f"n{i}" for i in range(2500)], ["rare" if i % 83 == 0 else "other" for i in range(2500)]
    segments = frame(spark, ids, matrix, "segment_id", shelf=shelf)
    asked, qids = np.concatenate([vectors(6, 14), matrix[:3]]), [f"q{i}" for i in range(9)]
    keep = {i for i, s in zip(ids, shelf) if s == "rare"}
    index, queries = build_index(segments, keep=("shelf",), size=50), frame(spark, qids, asked, "query_id")
    rare = lambda rows: rows.where("shelf = 'rare'")
    whole = search_lists(queries, index, 10, probes=1, within=rare).collect()
    assert {(r.query_id, r.segment_id, r["rank"]) for r in whole} == brute(asked, matrix, qids, ids, 10, keep)
    short = search_lists(queries, index, 10, probes=1, limit=1, within=rare).collect()
    assert len(short) == 90 and {r.segment_id for r in short} <= keep  # filled, though not certified
    assert len(search_lists(queries, index, 40, within=rare).collect()) == 9 * len(keep)  # fewer than k exist
    assert search_lists(queries, index, 5, within=lambda rows: rows.where("false")).count() == 0
    assert search_lists(queries.limit(0), index, 5).count() == 0


def test_saved_index_answers_alike(spark, corpus):
    import tempfile
    _, _, _, segments = corpus
    asked = frame(spark, ["q0", "q1"], vectors(2, 5), "query_id")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    index = build_index(segments, size=40, path=folder)
    rows = lambda i: sorted(map(str, search_lists(asked, i, 5, probes=2, limit=3).collect()))
    assert index.folders > 1 and rows(load_index(spark, folder)) == rows(index)


def test_index_of_nothing(spark, corpus):
    none = corpus[3].limit(0)
    index = build_index(none)
    assert len(index.sizes) == 1 and search_lists(frame(spark, ["q"], vectors(1), "query_id"), index, 3).count() == 0


@pytest.mark.parametrize("shipped, parts", [(4096, 1), (4096, 24), (0, 1)])
def test_distances_do_not_follow_the_block(spark, shipped, parts):
    """A pair has the distance the SQL gives it, to the last digit, whatever block of the table it is worked out in."""
    from compare import connect
    want = connect("/root/testdata/sf0.1").execute("""SELECT q.vec_id, s.vec_id, round(list_cosine_distance(q.embedding::DOUBLE[],
      s.embedding::DOUBLE[]), 12) FROM embeddings q, embeddings s WHERE q.vec_id % 10 = 0""").fetchall()
    read = lambda key: spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", key)
    stored, asked = read("segment_id").repartition(parts), read("query_id").where("query_id % 10 = 0")
    found = search_exact(asked, stored, 2000, max_shipped=shipped).select("query_id", "segment_id", "distance").collect()
    different = set(map(tuple, found)) ^ set(want)
    assert len(found) == len(want) == 400_000 and not different


def test_filter_comes_before_ranking(spark):
    ids = [f"s{i:03d}" for i in range(320)]
    segments = frame(spark, ids, vectors(320, 6), "segment_id", version_id=[f"v{i}" for i in range(320)],
                     profile_id=["p1"] * 320, modality=["text"] * 320)
    rows = [(f"v{i}", {"department": '"service"'} if i < 4 else {"n": '"1"'}, f"n/{i}", "text/plain") for i in range(320)]
    members = spark.createDataFrame(rows, "version_id string, metadata map<string,string>, path string, media_type string")
    asked = frame(spark, ["q"], vectors(1, 7), "query_id")
    hits = search_exact(asked, eligible(segments, members, "p1", Filter({"department": "service"})), 10)
    assert {r.segment_id for r in hits.collect()} == set(ids[:4])
    assert eligible(segments, members, "p1", Filter({"n": 1})).count() == 0  # the number 1 is not the text "1"


def test_identifiers(spark):
    cases = {"What is PS-400 torque in ISO VG 46 oil?": ["PS-400", "ISO", "VG", "46"], "no codes here": [],
             "GX-18, gx-18 and GX-18 again; v2.1/b": ["GX-18", "gx-18", "v2.1/b"], "_A1 x_y Ab A/B": ["A1"],
             "A" * 3 + " Zz9. IT": ["AAA", "Zz9.", "IT"], " ".join(f"a{i}" for i in range(20)): [f"a{i}" for i in range(12)],
             "AB.c DEF": ["DEF"]}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.ids for r in df.select("text", identifiers(F.col("text")).alias("ids")).collect()} == cases


PASSAGES = {"s1": "The PS-400 pump needs PS-400 oil.", "s2": "Pump 400 and the ps are apart here PS x 400",
            "s3": "Nothing of note.", "s4": "PS only", **{f"t{i:02d}": f"The common AB code {i}" for i in range(30)}}


def passages(spark):
    ids = list(PASSAGES)
    return frame(spark, ids, vectors(len(ids), 8), "segment_id", content=list(PASSAGES.values()), modality=["text"] * len(ids))


def indexed(spark, segments, **options):
    index = open_term_index(spark, buckets=4, **options)
    index.add(segments)
    return index


def test_term_index_grows_by_versions(spark):
    """Batches are appended, replaced passages masked, counting by term moves no posting, and an index is opened again."""
    import tempfile
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/terms"
    rows = {"a-1": "The pump GX-18 and a pump", "b-1": "Nothing of GX note", "c-1": "", "d-1": None}
    put = lambda index, texts: index.add(spark.createDataFrame(list(texts.items()), "segment_id string, content string"))
    index = open_term_index(spark, folder, 4)
    put(index, rows)
    put(index, {"a-2": "Belts, not the pump"})
    index.mask(spark.createDataFrame([("a-1",), ("a-1",)], "segment_id string"))
    found = {(r.segment_id, r.term): r.positions for r in open_term_index(spark, folder, 4).postings().collect()}
    assert found == {("b-1", "nothing"): [1], ("b-1", "gx"): [3], ("b-1", "note"): [4], ("a-2", "belts"): [1], ("a-2", "pump"): [4]}
    table = spark.table(index._name)
    assert table.where("term = 'pump'").count() == 2 and {r.positions[0] for r in table.where("segment_id = 'a-1' and term = '18'").collect()} == {4}
    plan = table.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_lists_keep_the_best_while_they_are_read(spark, monkeypatch):
    """A task that may hold few hits at a time gives the same answers."""
    from seamark.operators import ann
    monkeypatch.setattr(ann, "HELD_HITS", 1)
    segments, asked = frame(spark, [f"s{i:03d}" for i in range(600)], nested(600), "segment_id"), frame(spark, ["q1", "q2"], vectors(2, 5), "query_id")
    pick = lambda rows: sorted((r.query_id, r["rank"], r.segment_id) for r in rows.collect())
    assert pick(search_lists(asked, build_index(segments, size=64), 7)) == pick(search_exact(asked, segments, 7))


def test_tasks_that_write_the_index_grow_with_the_text(spark, monkeypatch):
    """A bucket is written by as many tasks as its text takes, and large tables get more buckets."""
    monkeypatch.setattr(term_index, "TASK_BYTES", 2000)
    texts = spark.range(2000).select(F.format_string("s%04d", "id").alias("segment_id"), F.concat(F.lit("common word "), "id").alias("content"))
    index = indexed(spark, texts)
    files = {f.rsplit("/", 1)[1]: 0 for f in spark.read.parquet(f"{index.path}/postings").inputFiles()}
    assert len(files) >= 12  # 31 kB of text; four buckets alone would give four files, and one for the common words
    found = index.postings()
    assert found.count() == 6000 and found.where("term = 'common'").select("segment_id").distinct().count() == 2000
    rows = spark.read.parquet(f"{index.path}/postings").where("term = 'common'").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in rows) < 1000
    assert [term_index.buckets_for(n) for n in (0, 10 ** 8, 6 * 10 ** 9)] == [8, 8, 256]


def test_texts_are_indexed_where_they_are_read(spark, monkeypatch):
    """Vectors too large to be broadcast do not bring the texts into a shuffle on their way to the index."""
    from seamark.plans.bindings import Tables
    given, tables = [], Tables(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(term_index.TermIndex, "add", lambda self, segments, size=None: given.append(segments.select("segment_id", "content")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tables.postings.count() == 0
        plan = given[0]._jdf.queryExecution().executedPlan().toString()
        want = tables.p1.select("segment_id", "content")
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert given[0].exceptAll(want).isEmpty() and want.exceptAll(given[0]).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_selective_terms_and_proximity(spark):
    segments = passages(spark)
    asked = spark.createDataFrame([("q1", "Which oil for PS-400?"), ("q2", "the AB code IT"), ("q3", "plain words"),
                                   ("q4", "PS-400 and XX99")], "query_id string, text string")
    index = indexed(spark, segments).postings()
    kept = {(r.query_id, r.token): r.passages for r in selective_terms(asked, segments, index).collect()}
    assert kept == {("q1", "PS-400"): 2, ("q4", "PS-400"): 2}  # AB is in most passages, IT is a stop word, XX99 nowhere
    rows = search_keyword(asked, segments, index, 10).collect()
    assert [(r.segment_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == "q1"] == [
        ("s1", 1.0), ("s2", 1.0 / 2)]  # 'PS x 400' spans three words for two terms
    assert {r.query_id for r in rows} == {"q1", "q4"}


def test_many_proposed_passages_are_not_shuffled(spark, monkeypatch):
    from seamark.operators import keyword
    names = [f"K{j}" for j in range(60)]
    texts = [(f"s{i:04}", " ".join(("x " * (i * j % 5) + n) for j, n in enumerate(names) if j % 10 == i % 10) + " 10.7.K1") for i in range(1000)]
    segments = spark.createDataFrame(texts, "segment_id string, content string")
    asked = spark.createDataFrame([(f"q{a}-{b}", f"{names[a]} {names[b]} 10.{a}.K1") for a in range(60) for b in range(a)], "query_id string, text string")
    index = indexed(spark, segments).postings()

    def ranked(most: int) -> tuple[set, int]:
        monkeypatch.setattr(keyword, "MAX_PROPOSED", most, raising=False)
        status = spark.sparkContext._jsc.sc()
        status.listenerBus().waitUntilEmpty()
        before = status.statusStore().executorList(True).apply(0).totalShuffleWrite()
        rows = {tuple(r) for r in search_keyword(asked, segments, index, 10).collect()}
        status.listenerBus().waitUntilEmpty()
        return rows, status.statusStore().executorList(True).apply(0).totalShuffleWrite() - before

    monkeypatch.setattr(keyword, "BLOCK_SETS", 700, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (by_index, shuffled), (by_text, less) = ranked(10**9), ranked(1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert by_text == by_index and len({q for q, *_ in by_text}) == 204  # 150 pairs stand together, K1 is in every passage
    assert less < shuffled / 2, (less, shuffled)


def test_hybrid_fuses_by_rank(spark):
    segments = passages(spark)
    asked = frame(spark, ["q1"], vectors(1, 9), "query_id", text=["PS-400 oil"])
    rows = {r.segment_id: r for r in search_hybrid(asked, segments, 40, indexed(spark, segments).postings()).collect()}
    exact = {r.segment_id: r["rank"] for r in search_exact(asked, segments, 160).collect()}
    for s, r in rows.items():
        want = 1 / (60 + exact[s]) + {"s1": 1 / 61, "s2": 1 / 62}.get(s, 0)
        assert abs(r.rrf - want) < 1e-12 and r.vector_rank == exact[s] and r.keyword_rank == {"s1": 1, "s2": 2}.get(s)
    order = sorted(rows.values(), key=lambda r: r["rank"])
    assert [r.segment_id for r in order] == [r.segment_id for r in sorted(order, key=lambda r: (-round(r.rrf, 12), r.distance))]


def test_hits_without_a_vector_follow_their_ties(spark):
    """A passage found by its words alone has no distance: equal in rank with the nearest vector, it comes after it."""
    segments = spark.createDataFrame([("s0", None, "text", "Form AB12"), ("s1", [1.0, 0.0], "text", "plain"), ("s2", [0.0, 1.0], "text", "plain")],
                                     "segment_id string, embedding array<float>, modality string, content string")
    asked = spark.createDataFrame([("q1", [1.0, 0.1], "AB12")], "query_id string, embedding array<float>, text string")
    words = indexed(spark, segments).postings()
    order = lambda rows: [r.segment_id for r in sorted(rows.collect(), key=lambda r: r["rank"])]
    assert order(search_hybrid(asked, segments, 10, words)) == ["s1", "s0", "s2"]
    assert order(search_balanced(asked, segments, 10, ["text"], words)) == ["s1", "s0", "s2"]
    ranked = spark.createDataFrame([("q1", "a", None, 1), ("q1", "b", 0.5, 1)], "query_id string, segment_id string, distance double, modality_rank int")
    assert order(interleave(ranked, 2)) == ["b", "a"]


def test_evidence_rechecks_files_and_context(spark):
    location = "struct<start:int,end:int,page:int,section:string,start_seconds:double,end_seconds:double,kind:string,type:string>"
    segments = spark.createDataFrame(
        [("s1", "v1", "text", (0, 9, None, "Care", None, None, None, None), "Oil it."),
         ("s2", "v2", "image", (None, None, 3, None, None, None, None, None), None),
         ("s3", "v3", "audio", (None, None, None, None, 0.0, 12.5, None, None), None)],
        f"segment_id string, version_id string, modality string, location {location}, content string")
    files = spark.createDataFrame([("f1", "a/x.md", {"k": "1"}, None), ("f2", "b.png", {}, None), ("f3", "c.wav", {}, "2024-01-01")],
                                  "file_id string, path string, metadata map<string,string>, deleted_at string")
    members = spark.createDataFrame([("f1", "v1"), ("f2", "v2"), ("f3", "v3")], "file_id string, version_id string")
    versions = spark.createDataFrame([(f"v{i}", i, n, m) for i, (n, m) in enumerate(
        [("x.md", "text/markdown"), ("b.png", "image/png"), ("c.wav", "audio/wav")], 1)],
        "version_id string, version_no int, filename string, media_type string")
    hits = spark.createDataFrame([("q", "s1", 0.1234567, 2), ("q", "s2", 0.05, 1), ("q", "s3", 0.2, 3)],
                                 "query_id string, segment_id string, distance double, rank int")
    found = evidence(hits, segments, members, files, versions)
    rows = {r.segment_id: r for r in found.collect()}
    assert set(rows) == {"s1", "s2"} and rows["s1"].score == 0.876543
    assert rows["s2"].media_url == "/files/f2/content?version_id=v2" and rows["s1"].source.path == "a/x.md"
    context = build_context(found).first()
    assert context.context == ("[1] b.png (page 3)\n<image segment from this file> (attached as image 1)\n\n"
                               "[2] a/x.md (section 'Care', chars 0-9)\nOil it.")
    assert context.images == ["v2"]


def test_evaluation(spark):
    results = spark.createDataFrame([("q1", 1, "a", "x fact"), ("q1", 2, "b", "y"), ("q2", 1, "b", "z"), ("q2", 3, "c", "other fact2")],
                                    "query_id string, rank int, path string, content string")
    labels = spark.createDataFrame([("q1", "b"), ("q2", "zz"), ("q3", "a")], "query_id string, expected_path string")
    e = eval_hits(results, labels, 5).first()
    assert (e.queries, round(e.hit_at_k, 6), round(e.mrr, 6)) == (3, 0.333333, 0.166667)
    facts = spark.createDataFrame([("q1", "fact", None), ("q2", "fact2", "c"), ("q3", "no", None)],
                                  "query_id string, fact string, path_prefix string")
    a = eval_answers(results, facts).first()
    assert (round(a.answer_at_1, 4), round(a.answer_at_3, 4)) == (0.3333, 0.6667)
    worse = spark.createDataFrame([(3, 0.3, 0.1)], "queries int, hit_at_k double, mrr double")
    assert not compare_runs(eval_hits(results, labels, 5), worse).first().no_regression
