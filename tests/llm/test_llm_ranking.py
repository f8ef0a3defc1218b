"""Centroid clustering, ranked search and prefix token counts on small tables with every odd case, against brute force."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_llm_texts import ROWS, docs, empty  # noqa: F401  (fixtures)

from seamark.llm import centroids, ranked_search, token_counts
from seamark.llm.common import shared_table
from seamark.llm.queries import QUERIES, vocabulary

SF_DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# --- token counts -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(vocabulary())


def every_prefix(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


@pytest.mark.parametrize("text", [
    "", "a", " ", " a", "a  b", "a \n b", "  a  b ", "it's we're they'll've 'r 'l ''re !'re", "x<|endoftext|>y <|endoftext|> z  <|endoftext|>",
    "<|endoftext|><|endoftext|>", "a  <|endoft", "!<|endoftext|>!", "\t\tfoo\n\n\n  bar 　 x", "naïve über 日本語 テスト 🙂🙂 é",
    "-" * 150, " " * 200 + "x", "\x1c\x1d a\x1cb \x85 c᠎d​ ﻿", "aaaa" * 60, "1234567890" * 8])
def test_prefix_counts(library, counter, text):
    assert token_counts.counts_of(*counter.deltas(text)).tolist() == every_prefix(library, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b", "the", "ing", "'s", "'re", "'l", "'", "!", "--", "1", "22", "é", "日", "🙂",
                                 "<|endoftext|>", "<|", "|>", "　", "\x1c", "\x85", "Z", "tion", " s"]), max_size=20))
def test_prefix_counts_of_any_text(library, counter, parts):
    text = "".join(parts)
    assert token_counts.counts_of(*counter.deltas(text)).tolist() == every_prefix(library, text)


def test_wide_differences(counter, monkeypatch):
    """Differences beyond one byte make a row four bytes wide."""
    monkeypatch.setattr(counter, "_chunk", lambda c: token_counts._packed([300] * len(c)))
    counter.chunks.clear()
    width, deltas = counter.deltas("abc de")
    counter.chunks.clear()
    assert width == 4 and token_counts.counts_of(width, deltas).tolist() == [0, 300, 300, 300, 600, 600, 600]


def test_stored_counts(spark, docs, empty, library):  # noqa: F811
    stored = shared_table(token_counts.prefix_table(docs, vocabulary()), "prefixes")
    want = Counter((k, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for k, x, _ in ROWS)
    assert Counter(tuple(r) for r in token_counts.token_totals(stored).collect()) == want
    texts = {k: x or "" for k, x, _ in ROWS if k not in (None, 8)}
    for budget in (0, 1, 7):
        cut = {r.doc_id: (r.chars, r.tokens) for r in token_counts.longest_prefixes(stored, budget).where("doc_id <> 8").collect()}
        for k, x in texts.items():
            counts = every_prefix(library, x)
            at = max(i for i, c in enumerate(counts) if c <= budget)
            assert cut[k] == (at, counts[at])
    asked = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (1, 10_000), (5, 2), (12, 9), (99, 1), (None, 3), (6, None)], "doc_id bigint, chars int")
    got = {(r.doc_id, r.chars): r.tokens for r in token_counts.tokens_before(stored, asked).collect()}
    prefix = lambda k, n: len(library.encode(texts[k][:n], add_special_tokens=False).ids)
    assert got == {(1, 0): 0, (1, 5): prefix(1, 5), (1, 10_000): None, (5, 2): prefix(5, 2), (12, 9): prefix(12, 9)}
    nothing = shared_table(token_counts.prefix_table(empty, vocabulary()), "prefixes")
    assert token_counts.token_totals(nothing).count() == 0 and token_counts.longest_prefixes(nothing, 3).count() == 0


def test_token_counts_query(spark, library):
    texts = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, SF_DIR).collect()}
    sizes = {k: (len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for k, x in texts}
    assert got == {k: (b, n, n > 1024) for k, (b, n) in sizes.items()}


# --- centroids ----------------------------------------------------------------------------------------------------

def nearest(x, table):
    d = ((x[:, None, :] - table[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("k, spread", [(1, 5), (2, 5), (3, 2), (16, 1), (16, 50), (70, 3), (200, 1000)])
def test_tree_assigns_as_brute_force(k, spread):
    rng = np.random.default_rng(k + spread)
    table = rng.integers(-spread, spread + 1, (k, 4))
    table[k // 2:] = table[:k - k // 2]  # equal centroids: ties
    x = rng.integers(-spread, spread + 1, (500, 4))
    number, distance, computed = centroids.assign(x, table, centroids.vantage_tree(table))
    want = nearest(x, table)
    assert (number == want[0]).all() and (distance == want[1]).all() and computed <= x.shape[0] * k


def test_tree_prunes():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 1000, (256, 3))
    x = rng.integers(0, 1000, (1000, 3))
    number, _, computed = centroids.assign(x, table, centroids.vantage_tree(table))
    assert (number == nearest(x, table)[0]).all() and computed < 0.25 * x.shape[0] * len(table)


def plain_kmeans(rows, k, rounds):
    xs = [(v, tuple(math.floor(64 * c) for c in x)) for v, x in rows]
    seeds = sorted((hashlib.sha256(f"1:{v}".encode()).hexdigest(), x) for v, x in xs if v is not None)[:k]
    table, x = np.array([s[1] for s in seeds]), np.array([x for _, x in xs])
    for _ in range(rounds):
        own = nearest(x, table)[0]
        table = np.array([x[own == c].sum(0) // (own == c).sum() if (own == c).any() else table[c] for c in range(len(table))])
    return nearest(x, table), table


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), [float(v) for v in rng.normal(size=3)]) for i in range(60)] + [(7, [0.1, 0.1, 0.1]), (7, [0.1, 0.1, 0.1]), (None, [0.5, -0.5, 0.0])]
    bad = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [NAN, 0.0, 0.0]), (105, [INF, 0.0, 0.0]), (106, [0.0] * 4)]
    table = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id bigint, embedding array<float>, cluster int, distance string").repartition(5)
    good = [(v, [float(np.float32(c)) for c in x]) for v, x in good]
    assigned, final = centroids.cluster(table, 5, 3, 3)
    (number, distance), want = plain_kmeans(good, 5, 3)
    assert (final == want).all()
    rows = centroids.with_inertia(assigned, final).collect()
    inertia = {c: int(distance[number == c].sum()) for c in set(number.tolist())}
    digest = {c: hashlib.sha256(",".join(map(str, want[c].tolist())).encode()).hexdigest() for c in inertia}
    assert Counter(tuple(r) for r in rows) == Counter(
        (v, c, d, inertia[c], int(distance.sum()), digest[c]) for (v, _), c, d in zip(good, number.tolist(), distance.tolist()))
    few, _ = centroids.cluster(table.where("vec_id < 3"), 5, 2, 3)
    assert few.count() == 3
    none = centroids.with_inertia(*centroids.cluster(table.where("vec_id >= 100"), 5, 2, 3))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_components_too_large_for_exact_distances():
    with pytest.raises(ValueError):
        centroids.integers(np.array([[1e30, 0.0]]))


# --- ranked search ------------------------------------------------------------------------------------------------

def plain_words(text):
    import re
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(up) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(rows, items, k=10):
    bags = [(key, Counter(plain_words(x))) for key, x in rows]
    held = [(key, b, sum(b.values())) for key, b in bags if b]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, b, _ in held for t in b)
    out = Counter()
    for item, text in set(items):
        scores = []
        for key, bag, n in held:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in set(plain_words(text)) if bag[t])
            if score > 0 and key is not None:
                scores.append((-score, key))
        out.update((item, r, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1))
    return out


ITEMS = [(1, "Under the MIT License"), (2, None), (3, ""), (4, "w1x w2x W3X w4x w5x w6x w1x"), (4, "w1x w2x W3X w4x w5x w6x w1x"), (5, "É"),
         (6, "nowhere"), (None, "one w9x"), (7, "w10x"), (8, "c d 12 's")]


@pytest.mark.parametrize("docs_a_shard, block, block_items", [(8192, 256, 10_000), (3, 2, 10_000), (5, 1, 3)])
def test_ranking_of_odd_rows(spark, docs, empty, monkeypatch, docs_a_shard, block, block_items):  # noqa: F811
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block_items)
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id bigint, text string, doc_id string, rank int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.rank(docs, items, 3).collect())
    assert got == plain_ranking([r[:2] for r in ROWS], ITEMS, 3)
    assert ranked_search.rank(empty, items).count() == 0 and ranked_search.rank(docs, items.limit(0)).count() == 0


def corpus(n, seed):
    """Zipf words, so that pairs of words often occur apart and rarely together."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(5, 40)) if w < 5000) or "w1") for i in range(n)]


def shards_of(rows, items, size):
    asked = ranked_search.ask(items)
    words = [(k, ranked_search.words_of(x.encode())) for k, x in rows]
    df = Counter(asked.vocabulary[w] for _, ws in words for w in set(ws) if w in asked.vocabulary)
    asked = asked.weighed(len(rows), sum(len(w) for _, w in words), np.array([df[t] for t in range(len(asked.vocabulary))]))
    shards = []
    for at in range(0, len(words), size):
        bags = [(k, len(ws), Counter(asked.vocabulary[w] for w in ws if w in asked.vocabulary)) for k, ws in words[at:at + size]]
        flat = [(t, n) for _, _, b in bags for t, n in b.items()]
        arrays = ranked_search.build_shard([k for k, _, _ in bags], [n for _, n, _ in bags], [len(b) for _, _, b in bags],
                                           [t for t, _ in flat], [n for _, n in flat], asked)
        shards.append({c: v.tobytes() for c, v in arrays.items()})
    return asked, shards


def test_pair_bounds_skip_more_and_lose_nothing():
    rows = corpus(6000, 1)
    items = [(i, x) for i, (_, x) in enumerate(corpus(25, 2))]
    asked, shards = shards_of(rows, items, 2000)
    want = plain_ranking(rows, items)
    read = {}
    for with_pairs in (True, False):
        found, reached, read[with_pairs] = {}, [0] * len(items), 0
        for raw in shards:
            shard = ranked_search.Shard(raw, asked)
            for i, chain in enumerate(asked.chains):
                docs_, scores = shard.search(chain, 10, reached[i], with_pairs)
                if i in found:
                    docs_, scores = ranked_search.best(np.concatenate([found[i][0], docs_]), np.concatenate([found[i][1], scores]), 10)
                found[i] = docs_, scores
                if len(docs_) == 10:
                    reached[i] = max(reached[i], int(scores[-1]))
            read[with_pairs] += shard.read
        got = Counter((asked.items[i][0], r, int(d), int(s)) for i, (ds, ss) in found.items() for r, (d, s) in enumerate(zip(ds, ss), 1))
        assert got == want
    assert read[True] < read[False]


def test_bounds_hold_for_every_document():
    rows = corpus(500, 5)
    asked, (raw,) = shards_of(rows, [(i, x) for i, (_, x) in enumerate(corpus(10, 6))], 500)
    shard = ranked_search.Shard(raw, asked)
    for chain in asked.chains:
        chain = [t for t in chain if t in shard.span]
        rest = shard.rest_bounds(chain)
        for i in range(len(chain) + 1):
            scores = np.zeros(len(shard.docs), np.int64)
            for t in chain[i:]:
                scores[shard.slots[shard.span[t]]] += shard.parts[shard.span[t]] * asked.weights[t]
            assert (scores <= rest[i][shard.block_of]).all()


def test_first_thresholds_are_reached(spark):
    rows, items = corpus(3000, 8), [(i, x) for i, (_, x) in enumerate(corpus(12, 9))]
    asked, shards = shards_of(rows, items, 1000)
    index = spark.createDataFrame([tuple(s[c] for c in ranked_search.SHARD) for s in shards], ranked_search.SHARD_ROW)
    given = ranked_search.first_thresholds(index, asked, 10)
    tenth = {item: s for item, r, _, s in plain_ranking(rows, items) if r == 10}
    assert all(given[i] <= tenth.get(key, 0) for i, (key, _) in enumerate(asked.items)) and (given > 0).any()
