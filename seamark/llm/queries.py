"""The training-data operators bound to the given tables, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.llm import (centroids, decontamination, licenses, line_dedup, mpeg, packing, ranked_search, sharding, simhash, token_counts,
                         token_store, toxicity, url_rules)
from seamark.llm.common import literal_rows, shared_table, table
from seamark.session import ship_package

def vocabulary() -> str:
    """The byte-level vocabulary that the contracts name; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, vocabulary())
    found = token_store.fetch(store, docs, "doc_id")
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


@query("op3_shard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query("op4_pack")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


# Fixed values of the contract: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op5_url_rules", f"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
    rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
             FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    sites AS (SELECT DISTINCT host, path FROM parts),
    best AS (SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                    max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
             FROM sites JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
             GROUP BY host, path)
    SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, ["host", "path", "verdict"], URL_RULES)
    judged = url_rules.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")




WORDS_SQL = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PARTS = line_dedup.EDITS + 1


@query("op6_line_dedup", f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    firsts AS (SELECT line, min((doc_id, pos)) AS spot FROM lines WHERE length(line) >= {line_dedup.EXACT_FROM} GROUP BY line),
    long AS (SELECT line, length(line) AS n FROM firsts WHERE length(line) >= {line_dedup.NEAR_FROM}),
    parts AS (SELECT line, n, i, n // {_PARTS} * i + greatest(0, i - ({_PARTS} - n % {_PARTS})) AS since,
                     n // {_PARTS} + CASE WHEN i >= {_PARTS} - n % {_PARTS} THEN 1 ELSE 0 END AS size
              FROM long CROSS JOIN range({_PARTS}) AS r(i)),
    pieces AS (SELECT *, substr(line, since + 1, size) AS piece FROM parts),
    shapes AS (SELECT DISTINCT n, i, since, size FROM parts),
    tries AS (SELECT a.line, s.n, s.i, substr(a.line, s.since + 1 + shift, s.size) AS piece
              FROM long a JOIN shapes s ON s.n BETWEEN a.n - {line_dedup.EDITS} AND a.n
              CROSS JOIN range(-{line_dedup.EDITS}, {line_dedup.EDITS} + 1) AS r(shift) WHERE s.since + shift >= 0),
    pairs AS (SELECT DISTINCT t.line AS a, p.line AS b FROM tries t JOIN pieces p ON t.n = p.n AND t.i = p.i AND t.piece = p.piece
              WHERE length(p.line) < length(t.line) OR p.line < t.line),
    near AS (SELECT DISTINCT a AS line FROM pairs WHERE levenshtein(a, b) <= {line_dedup.EDITS}),
    judged AS (SELECT doc_id, pos, lines.line, length(lines.line) < {line_dedup.EXACT_FROM} OR ((doc_id, pos) = firsts.spot AND near.line IS NULL) AS stays,
                      length(lines.line) >= {line_dedup.EXACT_FROM} AND (doc_id, pos) = firsts.spot AND near.line IS NOT NULL AS is_near
               FROM lines LEFT JOIN firsts ON lines.line = firsts.line LEFT JOIN near ON lines.line = near.line)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, CAST(count(*) AS INTEGER) AS n_lines,
           CAST(count(*) FILTER (WHERE NOT stays AND NOT is_near) AS INTEGER) AS n_exact, CAST(count(*) FILTER (WHERE is_near) AS INTEGER) AS n_near
    FROM judged GROUP BY doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_exact", "n_near")


_TEMPLATES = [(k, label, k < len(licenses.PHRASES), text) for k, (text, label) in enumerate(licenses.PHRASES + licenses.NOTICES)]


@query("op7_licenses", f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
    templates(template, label, phrase, body) AS (VALUES {', '.join(map(str, _TEMPLATES))}),
    tw AS (SELECT *, string_split(body, ' ') AS w FROM templates),
    grams AS (SELECT template, label, phrase, len(w) - 2 AS n, j, array_to_string(w[j + 1:j + 3], ' ') AS g
              FROM (SELECT *, unnest(range(len(w) - 2)) AS j FROM tw)),
    hits AS (SELECT doc_id, template, label, phrase, n, i, j, i - j AS diagonal
             FROM (SELECT doc_id, i, array_to_string(w[i + 1:i + 3], ' ') AS g
                   FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)) JOIN grams USING (g)),
    votes AS (SELECT doc_id, template, label, phrase, n, diagonal, count(*) AS votes, min(i) AS lo, max(i) AS hi FROM hits GROUP BY ALL),
    lagged AS (SELECT *, lag(diagonal) OVER o AS before, lag(hi) OVER o AS until FROM votes WHERE NOT phrase
               WINDOW o AS (PARTITION BY doc_id, template ORDER BY lo, diagonal)),
    runs AS (SELECT *, sum(CASE WHEN before IS NULL OR abs(diagonal - before) > {licenses.SHIFT} OR lo - until > {3 + licenses.SHIFT}
                                THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY lo, diagonal) AS run FROM lagged),
    whole AS (SELECT doc_id, template, label, n, run, min(lo) AS lo, max(hi) + 3 AS upto FROM runs GROUP BY ALL),
    stands AS (SELECT r.doc_id, r.template, r.run, count(DISTINCT p) AS words
               FROM runs r JOIN d USING (doc_id) JOIN tw t ON t.template = r.template, range(len(t.w)) AS x(p)
               WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = r.doc_id AND h.template = r.template AND h.diagonal = r.diagonal
                             AND p BETWEEN h.j AND h.j + 2) AND d.w[p + r.diagonal + 1] = t.w[p + 1] GROUP BY ALL),
    spans AS (SELECT doc_id, label, phrase, lo, 1.0::DOUBLE AS cover FROM votes WHERE phrase AND votes = n
              UNION ALL SELECT doc_id, label, false, lo, words::DOUBLE / (n + 2) FROM whole JOIN stands USING (doc_id, template, run)
              WHERE upto - lo <= {licenses.STRETCH} * (n + 2) + {licenses.SHIFT}),
    found AS (SELECT doc_id, count(*) FILTER (WHERE phrase) AS n_base, min(lo) FILTER (WHERE phrase) AS first_word,
                     max(lo) FILTER (WHERE phrase) AS last_word,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE phrase)), ',') AS base_labels,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE phrase OR cover >= {licenses.COVER})), ',') AS labels,
                     max(cover) AS score FROM spans GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN found USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


@query("op8_decontaminate", f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
    b AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
    places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
    n_hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tie")


@query("op9_mpeg")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = shared_table(mpeg.encode_texts(table(spark, sf_dir, "documents")), "media")
    return mpeg.read_media(stored)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _round_sql(k: int) -> str:
    """Assignment to the centroids of round k - 1, and their means."""
    return f"""
    d{k} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM cells v JOIN c{k - 1} c USING (i) GROUP BY ALL),
    a{k} AS (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{k} GROUP BY row),
    m{k} AS (SELECT a.cluster, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN cells v USING (row) GROUP BY ALL),
    c{k} AS (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
             FROM c{k - 1} c LEFT JOIN m{k} m ON m.cluster = c.cluster AND m.i = c.i),"""


@query("op11_centroids", f"""
    WITH kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS xs
                  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
    cells AS (SELECT row, unnest(xs) AS x, unnest(range(64)) AS i FROM kept),
    seeds AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), xs) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL
              QUALIFY cluster < 16),
    c0 AS (SELECT cluster, i, x FROM seeds JOIN cells USING (row)),
    {_round_sql(1)}{_round_sql(2)}{_round_sql(3)}
    d4 AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM cells v JOIN c3 c USING (i) GROUP BY ALL),
    a4 AS (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d4 GROUP BY row),
    digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
           CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a4 JOIN kept USING (row) JOIN digests USING (cluster)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings"), 16, 3, 64))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = shared_table(token_counts.prefix_table(table(spark, sf_dir, "documents"), vocabulary()), "prefixes")
    return token_counts.token_totals(stored).withColumn("over_limit", F.col("n_tokens") > 1024)


RANK_WORDS_SQL = """list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""


@query("op12_ranked_search", f"""
    WITH d AS (SELECT doc_id, {RANK_WORDS_SQL} AS terms FROM documents WHERE text IS NOT NULL),
    corpus AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
    b AS (SELECT DISTINCT item_id, unnest(list_distinct({RANK_WORDS_SQL})) AS term FROM benchmark WHERE text IS NOT NULL),
    tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
               FROM b JOIN tf USING (term) JOIN w USING (term), corpus GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
