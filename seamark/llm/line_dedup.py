"""Line deduplication: exact copies, and near copies by a segment-partition edit join, in DataFrame functions only.

If two lines are within ``edits`` edits, one of ``edits`` + 1 even segments of the shorter line stands unchanged in the
longer one, shifted by few places (Li et al., Pass-Join, 2011). Every line offers its segments under its length; every
line looks up, for its own and the next shorter lengths, just the substrings at the places that can matter. Lines that
meet are compared by Spark's banded edit distance, which stops at the threshold.

First the keys alone are counted, without text, and only keys that two different lines share go on; while these are few they
are broadcast, and beyond that still no text is shuffled but that of lines which have one. A key's lines are
dealt into chunks of bounded size; a looking line meets a chunk as one row with its lines in an array and yields one
answer, so no pairs are emitted, however many lines share a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.llm.common import document_key, matching, shared_table

EDITS = 2
EXACT_FROM, NEAR_FROM = 20, 40   # characters from which a line is compared at all, and for near copies
CHUNK = 128
SMALL = 1_000_000                # keys that may be broadcast, 8 bytes each


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tie, pos, line) of all lines of ``EXACT_FROM`` characters or more."""
    return docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), document_key(F.col(text)).alias("tie"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(
        F.length("line") >= EXACT_FROM)


def segment_keys(line: Column, length: Column, edits: int) -> Column:
    """array<struct<key, stored>>: hashes under which a line looks for lines of its length and shorter ones; under those
    marked ``stored`` it can be found itself, too.

    Segment i of ``edits`` + 1 even ones (the last ones take the remainder) of a line with ``fewer`` characters less can
    stand unchanged in this line only at a few shifts: not further than the edits before it, nor than those after it. As
    segments are longer than ``edits`` from ``NEAR_FROM`` characters on, all these places lie inside the line.
    """
    parts = edits + 1
    looks = [(fewer, i, shift) for fewer in range(parts) for i in range(parts)
             for shift in range(max(-i, fewer - (edits - i)), min(i, fewer + (edits - i)) + 1)]
    fixed = F.array(*(F.struct(F.lit(f).alias("fewer"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for f, i, s in looks))

    # A function over a fixed array keeps the generated code small enough to be compiled.
    def key(look: Column) -> Column:
        n = length - look["fewer"]
        whole = parts - n % parts  # segments before the longer ones
        base = F.call_function("div", n, F.lit(parts)).cast("int")
        start = base * look["i"] + F.greatest(F.lit(0), look["i"] - whole) + look["shift"]
        size = base + (look["i"] >= whole).cast("int")
        return F.struct(F.xxhash64(n, look["i"], F.substring(line, start + 1, size)).alias("key"),
                        ((look["fewer"] == 0) & (look["shift"] == 0)).alias("stored"))

    return F.transform(fixed, key)


def near_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, id2) of the lines within ``edits`` edits of a shorter line, or of one as long that sorts before them."""
    if NEAR_FROM - edits < (edits + 1) ** 2:
        raise ValueError("segments must be longer than the edits: compare longer lines or allow fewer edits")
    long = lines.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("id")).where(F.col("n") >= NEAR_FROM)
    keys = segment_keys(F.col("line"), F.col("n"), edits)
    spread = long.select("id", F.inline(keys))
    shared = shared_table(spread.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key"), "segments")
    if shared.limit(SMALL + 1).count() <= SMALL:
        met = long.select("id", "line", F.inline(keys)).join(F.broadcast(shared), "key")
    else:  # keys meet without text, and only the lines that have a shared one are shuffled, once
        shares = shared_table(matching(spread, shared, "key", SMALL).distinct(), "shares")
        wanted = shared_table(shares.select("id").distinct(), "wanted-lines")
        met = shares.join(matching(long.select("id", "line"), wanted, "id", SMALL).distinct(), "id")
    held = shared_table(met.select("key", "stored", "id", "line").distinct(), "candidates")
    counts = held.groupBy("key").agg(F.sum(F.col("stored").cast("int")).alias("n"), F.count("*").alias("m")).where("n > 0 and m > 1").select(
        "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = held.join(counts, "key")
    chunks = dealt.where("stored").groupBy("key", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk")).agg(
        F.collect_list("line").alias("others"))  # about CHUNK lines
    asking = dealt.select("key", "id", "line", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    n = F.length("line")
    near = F.exists("others", lambda o: ((F.length(o) < n) | ((F.length(o) == n) & (o < F.col("line")))) & (
        n - F.length(o) <= edits) & (F.levenshtein(o, F.col("line"), edits) >= 0))
    return asking.join(chunks, ["key", "chunk"]).where(near).select("id", F.xxhash64(F.lit(1), "line").alias("id2")).distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, prefix: str = "") -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text``, and ``prefix`` n_lines, n_exact, n_near.

    Of equal lines the first in the order of doc_id and position stays; of nearly equal ones the shorter, or of equal
    length the one that sorts first, and its text decides for all its copies. Lines under ``EXACT_FROM`` characters always
    stay, lines under ``NEAR_FROM`` go only as exact copies. A null text stays null with 0 lines. Rows equal in doc_id
    and text are one document whose copies all keep its lines. An empty table gives no rows; all other columns stay.
    """
    lines = lines_of(docs, doc_id, text)
    occurrences = lines.select("doc_id", "tie", "pos", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))
    firsts = occurrences.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "tie", "pos")).alias("first"))
    near = near_lines(lines, edits).withColumn("near", F.lit(True))
    judged = firsts.join(near, ["id", "id2"], "left").select("first.*", F.coalesce("near", F.lit(False)).alias("near"))
    kept = judged.groupBy("doc_id", "tie").agg(F.collect_list(F.when(~F.col("near"), F.col("pos"))).alias("__kept"),
                                               F.sum(F.col("near").cast("int")).alias("__near")).withColumnsRenamed(
        {"doc_id": "__id", "tie": "__tie"})
    own = F.col(doc_id).eqNullSafe(F.col("__id")) & (document_key(F.col(text)) == F.col("__tie"))
    met = docs.drop(*(prefix + n for n in ("n_lines", "n_exact", "n_near"))).join(kept, own, "left").withColumn("__lines", F.split(text, "\n"))
    short = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.length(F.get(F.col("__lines"), i)) < EXACT_FROM)
    staying = F.array_sort(F.concat(short, F.coalesce("__kept", F.array().cast("array<int>"))))
    placed = met.withColumn("__stay", F.when(F.col(text).isNotNull(), staying))
    return placed.withColumns({
        text: F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n"),
        prefix + "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")),
        prefix + "n_near": F.coalesce("__near", F.lit(0)).cast("int"),
        prefix + "n_exact": F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines") - F.size("__stay") - F.coalesce("__near", F.lit(0))).cast("int"),
    }).drop("__id", "__tie", "__kept", "__near", "__lines", "__stay")
