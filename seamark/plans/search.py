"""Queries of retrieval and its evaluation."""

import uuid

from pyspark.sql import functions as F

from seamark.functions.text import identifiers
from seamark.operators.ann import build_index, search_lists
from seamark.operators.evaluation import (check_export, compare_runs, eval_answers, eval_cross_modal, eval_hits, eval_recall)
from seamark.operators.evidence import build_context, evidence
from seamark.operators.filters import Filter
from seamark.operators.hybrid import search_balanced, search_hybrid
from seamark.operators.keyword import search_keyword, selective_terms
from seamark.operators.statistics import store_stats
from seamark.operators.vector_search import eligible, search_exact
from seamark.plans.registry import query
from seamark.session import checkpoint_root
from seamark.sources.export import export_segments, read_export, write_export


def topk_sql(source: str, k: int, name: str = "vec") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.query_id, s.segment_id, round(list_cosine_distance(q.embedding, s.embedding), 12)
  AS distance, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_distance(q.embedding, s.embedding), 12),
  s.segment_id) AS rank FROM queries q, {source} s) WHERE rank <= {k})"""


KEYWORD_SQL = """
tokens AS (SELECT DISTINCT query_id, unnest(ids) AS token FROM (SELECT query_id, ids FROM word_queries)),
token_terms AS (SELECT DISTINCT token, term FROM (SELECT token, unnest(regexp_extract_all(lower(token), '[\\p{L}\\p{N}_]+')) AS term FROM
  (SELECT DISTINCT token FROM tokens)) WHERE term NOT IN (SELECT term FROM stop_words)),
token_size AS (SELECT token, count(*) AS n FROM token_terms GROUP BY token),
distinct_postings AS (SELECT DISTINCT segment_id, term FROM postings),
token_df AS (SELECT token, count(*) AS passages FROM (SELECT token, segment_id, count(*) AS c FROM token_terms JOIN distinct_postings
  USING (term) GROUP BY ALL) JOIN token_size USING (token) WHERE c = n GROUP BY token),
selective AS (SELECT query_id, token, passages FROM tokens JOIN token_df USING (token), eligible e
  WHERE passages <= greatest(1.0, e.n * 0.1)),
asked AS (SELECT DISTINCT query_id, term FROM selective JOIN token_terms USING (token)),
asked_size AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
hits AS (SELECT query_id, segment_id, any_value(n) AS n FROM asked JOIN distinct_postings USING (term) JOIN asked_size USING (query_id)
  GROUP BY query_id, segment_id HAVING count(*) = any_value(n)),
occ AS (SELECT query_id, segment_id, h.n, p.term, p.pos FROM hits h JOIN asked a USING (query_id) JOIN postings p USING (segment_id, term)),
spans AS (SELECT query_id, segment_id, e, n, e - min(last_pos) + 1 AS span FROM (
    SELECT a.query_id, a.segment_id, a.pos AS e, b.term, a.n, max(b.pos) FILTER (b.pos <= a.pos) AS last_pos
    FROM (SELECT DISTINCT query_id, segment_id, n, pos FROM occ) a JOIN occ b USING (query_id, segment_id) GROUP BY ALL)
  GROUP BY query_id, segment_id, e, n HAVING count(last_pos) = n),
kw_all AS (SELECT query_id, segment_id, 1.0::DOUBLE / (1 + min(span) - n) AS score FROM spans GROUP BY query_id, segment_id, n),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank FROM kw_all)
  WHERE rank <= 40)"""
HYBRID_KEYWORD_SQL = KEYWORD_SQL.replace("(SELECT query_id, ids FROM word_queries)", """(SELECT query_id,
  list_filter(found, lambda t, i: list_position(found, t) = i)[1:12] AS ids FROM (SELECT query_id,
  list_filter(regexp_extract_all(text, '[A-Za-z0-9][\\w.\\-/]*'), lambda t: regexp_matches(t, '[0-9]') OR
  regexp_matches(t, '^[A-Z]{2,}[\\w\\-]*$')) AS found FROM queries))""")


def fused_sql(k: int, allowed: str = "p1") -> str:
    return f"""
fused AS (SELECT query_id, segment_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) FILTER (src = 'kw') AS keyword_rank,
  min(rank) FILTER (src = 'vec') AS vector_rank FROM (SELECT query_id, segment_id, rank, 'vec' AS src FROM vec UNION ALL
  SELECT query_id, segment_id, rank, 'kw' FROM kw) GROUP BY ALL),
located AS (SELECT f.*, s.modality, round(list_cosine_distance(q.embedding, s.embedding), 12) AS distance FROM fused f
  JOIN {allowed} s USING (segment_id) JOIN queries q USING (query_id)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, distance, segment_id) AS rank
  FROM located) WHERE rank <= {k})"""


@query("vector_topk", f"""WITH {topk_sql("p1", 10)}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, round(1 - distance, 6) AS score FROM vec""")
def vector_topk(t):
    return search_exact(t.queries, t.p1, 10).select("query_id", "segment_id", "rank", F.round(1 - F.col("distance"), 6).alias("score"))


_FILTERED = """shown AS (SELECT p.* FROM p1 p WHERE version_id IN (SELECT version_id FROM members WHERE store_id = 'v_top'
  AND m_lang = '"en"' AND starts_with(path, 'src')) AND modality IN ('text', 'image'))"""


def _shown(t):
    own = t.members.where("store_id = 'v_top'")
    return eligible(t.segments, own, "p1", Filter({"lang": "en"}, "src"), ["text", "image"])


@query("vector_topk_filtered", f"""WITH {_FILTERED}, {topk_sql("shown", 10)}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, round(1 - distance, 6) AS score FROM vec""")
def vector_topk_filtered(t):
    return search_exact(t.queries, _shown(t), 10).select("query_id", "segment_id", "rank",
                                                         F.round(1 - F.col("distance"), 6).alias("score"))


@query("vector_topk_grid", f"""WITH {topk_sql("p1", 5)}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, round(1 - distance, 6) AS score FROM vec""")
def vector_topk_grid(t):
    """The layout for query tables too large to ship, forced here by a zero limit."""
    return search_exact(t.queries, t.p1, 5, max_shipped=0).select("query_id", "segment_id", "rank",
                                                                 F.round(1 - F.col("distance"), 6).alias("score"))


@query("ann_topk", f"""WITH {topk_sql("p1", 10)}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, round(1 - distance, 6) AS score, true AS certified FROM vec""")
def ann_topk(t):
    """As many lists as a certified answer takes."""
    return search_lists(t.queries, build_index(t.p1), 10).select("query_id", "segment_id", "rank", F.round(1 - F.col("distance"), 6).alias("score"),
                                                                "certified")


@query("ann_topk_filtered", f"""WITH {_FILTERED}, {topk_sql("shown", 10)}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, round(1 - distance, 6) AS score, true AS certified FROM vec""")
def ann_topk_filtered(t):
    """The lists of all segments, searched for those that pass the filter of a store."""
    index = build_index(t.segments.where("profile_id = 'p1'"), keep=("version_id", "profile_id", "modality"))
    own = t.members.where("store_id = 'v_top'")
    hits = search_lists(t.queries, index, 10, within=lambda rows: eligible(rows, own, "p1", Filter({"lang": "en"}, "src"), ["text", "image"]))
    return hits.select("query_id", "segment_id", "rank", F.round(1 - F.col("distance"), 6).alias("score"), "certified")


@query("ann_recall")
def ann_recall(t):
    """Recall of a search that stops at three quarters of the lists, certified or not."""
    index = build_index(t.p1)
    found = search_lists(t.queries, index, 10, probes=8, limit=3 * len(index.sizes) // 4)
    return eval_recall(found, search_exact(t.queries, t.p1, 10), 10)


@query("identifiers", "SELECT doc_id, array_to_string(ids, ' ') AS ids FROM documents_ids")
def identifiers_query(t):
    return t.raw("documents").select("doc_id", F.array_join(identifiers(F.col("text")), " ").alias("ids"))


@query("postings", """
SELECT segment_id, term, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM postings GROUP BY segment_id, term""")
def postings(t):
    return t.postings.select("segment_id", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("selective_terms", f"WITH {KEYWORD_SQL} SELECT query_id, token, passages FROM selective")
def selective_terms_query(t):
    return selective_terms(t.word_queries, t.passages, t.postings).select("query_id", "token", "passages")


@query("keyword_rank", f"WITH {KEYWORD_SQL} SELECT query_id, segment_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kw")
def keyword_rank_query(t):
    return search_keyword(t.word_queries, t.passages, t.postings, 40).withColumn("score", F.round("score", 6))


_HYBRID = f"{topk_sql('p1', 40)}, {HYBRID_KEYWORD_SQL}, {fused_sql(10)}"


@query("hybrid_rrf", f"""WITH {_HYBRID}
SELECT query_id, segment_id, CAST(rank AS INTEGER) AS rank, CAST(keyword_rank AS INTEGER) AS keyword_rank,
  CAST(vector_rank AS INTEGER) AS vector_rank, round(1 - distance, 6) AS score FROM hybrid""")
def hybrid_rrf(t):
    return search_hybrid(t.queries, t.p1, 10, t.postings).select("query_id", "segment_id", "rank", "keyword_rank", "vector_rank",
                                                     F.round(1 - F.col("distance"), 6).alias("score"))


_BALANCED = """
per AS (SELECT q.query_id, s.segment_id, s.modality, round(list_cosine_distance(q.embedding, s.embedding), 12) AS distance,
  row_number() OVER (PARTITION BY q.query_id, s.modality ORDER BY round(list_cosine_distance(q.embedding, s.embedding), 12),
  s.segment_id) AS mr FROM queries q, p1 s QUALIFY mr <= 10)"""


@query("balanced_topk", f"""WITH {_BALANCED}
SELECT query_id, segment_id, modality, CAST(mr AS INTEGER) AS modality_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mr,
  distance, segment_id) AS INTEGER) AS rank FROM per QUALIFY rank <= 10""")
def balanced_topk(t):
    return search_balanced(t.queries, t.p1, 10).select("query_id", "segment_id", "modality", "modality_rank", "rank")


_TEXT_ONLY = "texts AS (SELECT * FROM p1 WHERE modality = 'text')"


@query("balanced_hybrid", f"""WITH {_TEXT_ONLY}, {topk_sql('texts', 40)}, {HYBRID_KEYWORD_SQL}, {fused_sql(10, 'texts')}, {_BALANCED},
every AS (SELECT query_id, segment_id, modality, distance, mr FROM per WHERE modality <> 'text' UNION ALL
  SELECT query_id, segment_id, modality, distance, rank FROM hybrid)
SELECT query_id, segment_id, modality, CAST(mr AS INTEGER) AS modality_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mr,
  distance, segment_id) AS INTEGER) AS rank FROM every QUALIFY rank <= 10""")
def balanced_hybrid(t):
    return search_balanced(t.queries, t.p1, 10, postings=t.postings).select("query_id", "segment_id", "modality", "modality_rank", "rank")


def _evidence(t):
    """Evidence of the hybrid hits in all live files, whatever store they are in."""
    shown = t.versions.join(t.files.where("deleted_at is null").select("file_id"), "file_id", "left_semi")
    return evidence(search_hybrid(t.queries, t.p1, 10, t.postings), t.p1, shown, t.files, t.versions)


_EVIDENCE = f"""{_HYBRID},
ev AS (SELECT h.query_id, h.rank, h.segment_id, round(1 - h.distance, 6) AS score, s.modality, CASE WHEN s.modality = 'text' THEN
  s.content END AS content, CASE WHEN s.modality <> 'text' THEN '/files/' || f.file_id || '/content?version_id=' || s.version_id END AS
  media_url, f.path, f.m_lang, v.version_no, s.version_id, s.loc_start, s.loc_end, s.page, s.section, s.start_seconds, s.end_seconds
  FROM hybrid h JOIN p1 s USING (segment_id) JOIN versions v ON v.version_id = s.version_id
  JOIN files f ON f.file_id = v.file_id AND f.deleted_at IS NULL)"""


@query("evidence", f"""WITH {_EVIDENCE}
SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, score, modality, content, media_url, path, version_no FROM ev""")
def evidence_query(t):
    return _evidence(t).select("query_id", "rank", "segment_id", "score", "modality", "content", "media_url",
                               F.col("source.path").alias("path"), F.col("source.version_no").alias("version_no"))


@query("rag_context", f"""WITH {_EVIDENCE},
img AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM ev WHERE modality = 'image'),
lines AS (SELECT e.query_id, e.rank, '[' || e.rank || '] ' || path || ' (' || CASE
  WHEN start_seconds IS NOT NULL THEN CAST(start_seconds AS BIGINT) || '-' || CAST(end_seconds AS BIGINT) || 's'
  WHEN page IS NOT NULL THEN 'page ' || page
  WHEN loc_start IS NOT NULL THEN CASE WHEN section <> '' THEN 'section ''' || section || ''', ' ELSE '' END || 'chars ' || loc_start || '-' || loc_end
  ELSE 'whole image' END || ')' || chr(10) || CASE WHEN modality = 'text' THEN content ELSE '<' || modality ||
  ' segment from this file>' || CASE WHEN i <= 2 THEN ' (attached as image ' || i || ')' ELSE '' END END AS line,
  CASE WHEN i <= 2 THEN version_id END AS image FROM ev e LEFT JOIN img USING (query_id, rank))
SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context, coalesce(string_agg(image, ',' ORDER BY rank), '') AS images
FROM lines GROUP BY query_id""")
def rag_context(t):
    return build_context(_evidence(t)).select("query_id", "context", F.array_join("images", ",").alias("images"))


def _results(t, hits):
    """Hits with the path and text of their file and the topic (label) of their segment."""
    return (hits.join(t.p1.select("segment_id", "version_id", "content", "modality", "label"), "segment_id")
            .join(t.versions.select("version_id", "file_id"), "version_id").join(t.files.select("file_id", "path"), "file_id")
            .select("query_id", "rank", "path", "content", "modality", F.concat(F.lit("t"), F.col("label").cast("string")).alias("topic")))


def _labels(t):
    """The expected file of a question is the one with the smallest path among those of its label."""
    paths = t.p1.join(t.versions.select("version_id", "file_id"), "version_id").join(t.files.select("file_id", "path"), "file_id")
    best = paths.groupBy(F.col("label").alias("query_label")).agg(F.min("path").alias("expected_path"))
    return t.queries.join(best, "query_label").select("query_id", "expected_path")


_LABELS_SQL = """labels_of AS (SELECT query_id, expected_path FROM queries JOIN (SELECT label, min(path) AS expected_path FROM p1
  JOIN versions v USING (version_id) JOIN files f ON f.file_id = v.file_id GROUP BY label) ON label = query_label)"""


def hits_sql(run: str, name: str) -> str:
    return f"""{name} AS (SELECT count(*) AS queries, avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_k,
  avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM labels_of l LEFT JOIN (SELECT r.query_id, min(r.rank) AS first FROM {run} r
  JOIN p1 s USING (segment_id) JOIN versions v ON v.version_id = s.version_id JOIN files f ON f.file_id = v.file_id JOIN labels_of l
  ON l.query_id = r.query_id AND l.expected_path = f.path WHERE r.rank <= 40 GROUP BY r.query_id) USING (query_id))"""


@query("eval_hit_mrr", f"""WITH {topk_sql("p1", 40)}, {_LABELS_SQL}, {hits_sql("vec", "e")}
SELECT queries, round(hit_at_k, 6) AS hit_at_k, round(mrr, 6) AS mrr FROM e""")
def eval_hit_mrr(t):
    e = eval_hits(_results(t, search_exact(t.queries, t.p1, 40)), _labels(t), 40)
    return e.select("queries", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


@query("compare_runs", f"""WITH {_HYBRID.replace('rank <= 10)', 'rank <= 40)')}, {_LABELS_SQL}, {hits_sql("vec", "a")}, {hits_sql("hybrid", "b")}
SELECT round(a.mrr, 6) AS mrr_a, round(b.mrr, 6) AS mrr_b, b.mrr >= a.mrr - 0.01 AS no_regression FROM a, b""")
def compare_runs_query(t):
    labels = _labels(t)
    a = eval_hits(_results(t, search_exact(t.queries, t.p1, 40)), labels, 40)
    b = eval_hits(_results(t, search_hybrid(t.queries, t.p1, 40, t.postings)), labels, 40)
    return compare_runs(a, b).select(F.round("mrr_a", 6).alias("mrr_a"), F.round("mrr_b", 6).alias("mrr_b"), "no_regression")


@query("eval_answer", f"""WITH {_TEXT_ONLY}, {topk_sql("texts", 3)},
facts AS (SELECT query_id, regexp_extract(text, '[A-Za-z]+') AS fact FROM queries),
r AS (SELECT f.query_id, v.rank, coalesce(contains(s.content, f.fact), false) AS ok FROM facts f LEFT JOIN vec v USING (query_id)
  LEFT JOIN texts s USING (segment_id)),
e AS (SELECT query_id, bool_or(ok AND rank = 1) AS one, bool_or(ok) AS three FROM r GROUP BY query_id)
SELECT count(*) AS queries, round(avg(one::INT), 6) AS answer_at_1, round(avg(three::INT), 6) AS answer_at_3 FROM e""")
def eval_answer(t):
    facts = t.queries.select("query_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("fact"), F.lit(None).cast("string").alias("path_prefix"))
    e = eval_answers(_results(t, search_exact(t.queries, t.p1.where("modality = 'text'"), 3)), facts)
    return e.select("queries", F.round("answer_at_1", 6).alias("answer_at_1"), F.round("answer_at_3", 6).alias("answer_at_3"))


@query("eval_cross_modal", f"""WITH {_BALANCED}
SELECT CASE WHEN query_label <= 5 THEN 'text' ELSE 'image' END AS query_modality, p.modality AS result_modality, count(*) AS queries,
  round(avg((s.label = q.query_label)::INT), 6) AS top1
FROM per p JOIN p1 s USING (segment_id) JOIN queries q USING (query_id) WHERE mr = 1 GROUP BY ALL""")
def eval_cross_modal_query(t):
    hits = search_exact(t.queries, t.p1, 1, group="modality").drop("modality")
    labels = t.queries.select("query_id", F.when(F.col("query_label") <= 5, "text").otherwise("image").alias("query_modality"),
                              F.concat(F.lit("t"), F.col("query_label").cast("string")).alias("expected_topic"))
    return eval_cross_modal(_results(t, hits), labels).withColumn("top1", F.round("top1", 6))


@query("check_export", """
SELECT m.store_id, count(*) AS lines, CAST(0 AS BIGINT) AS off_norm, CAST(0 AS BIGINT) AS without_source, count(*) AS expected_lines
FROM members m JOIN p1 USING (version_id) GROUP BY m.store_id""")
def check_export_query(t):
    export = export_segments(t.members, t.p1, t.files, t.versions)
    expected = store_stats(t.stores, t.members, t.versions, t.segments, "p1").select("store_id", "segments")
    return check_export(export, expected)


@query("export_best_match", f"""WITH shown AS (SELECT DISTINCT p.* FROM members m JOIN p1 p USING (version_id) WHERE m.store_id = 'v_deep'),
  {topk_sql("shown", 1)} SELECT query_id, segment_id AS best_segment, round(1 - distance, 6) AS score FROM vec""")
def export_best_match(t):
    """A store is exported as JSON lines and read again; the best match of every question by the exported vectors is the one
    that a search of the store gives."""
    place = f"{checkpoint_root(t.spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    write_export(export_segments(t.members.where("store_id = 'v_deep'"), t.p1, t.files, t.versions, ["embedding"]), place)
    return search_exact(t.queries, read_export(t.spark, place), 1).select(
        "query_id", F.col("segment_id").alias("best_segment"), F.round(1 - F.col("distance"), 6).alias("score"))
