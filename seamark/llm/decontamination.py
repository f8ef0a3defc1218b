"""Benchmark decontamination by winnowing (Schleimer et al., 2003), in DataFrame functions only.

Of the hashes of all ``K``-word grams, the smallest in each run of ``WINDOW`` neighbours is a fingerprint, so any two texts
that share ``WINDOW`` words in a row share a fingerprint inside them. Training texts meet the benchmark on fingerprints;
around each common one, every window of words that holds it is compared with the benchmark's windows word by word, and
overlapping hits join into longer spans. Items shorter than a window are looked up as grams of their own lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamark.llm.common import NOT_A_WORD, ascii_lower, broadcast_below, document_key, shared_table, split_words

WINDOW, K = 10, 5
PLACE_BITS = 30                       # a text has fewer than 2**30 words; the other 34 bits are of the gram's hash
PLACE = (1 << PLACE_BITS) - 1
SMALL = 500_000                       # rows of a few numbers that may be broadcast


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_A_WORD)


def _range(n: Column) -> Column:
    """0 .. n - 1, empty unless n > 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def candidate_hash(hashes: Column, at: Column, k: int) -> Column:
    """A cheaper hash of ``k`` words for hits that are compared word by word later: its bits from 7 k on mix all words."""
    out = F.get(hashes, at)
    for j in range(1, k):
        out = out.bitwiseXOR(F.shiftleft(F.get(hashes, at + j), 7 * j))
    return out


def gram_hash(hashes: Column, at: Column, k: int) -> Column:
    """A hash of ``k`` words from the hashes of single words; all of its bits depend on all words."""
    out = F.get(hashes, at)
    for j in range(1, k):
        out = out.bitwiseXOR(_rotated(F.get(hashes, at + j), (j * 13) % 64))
    return out


def fingerprints(rows: DataFrame, keep: list[str], window: int = WINDOW, k: int = K) -> DataFrame:
    """(keep..., hash, place) from a column ``words``: the winnowed grams of every text of at least ``window`` words."""
    span = window - k + 1
    hashed = rows.where(F.size("words") >= window).select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select(*keep, F.transform(_range(F.size("h") - k + 1), lambda i: candidate_hash(F.col("h"), i, k).bitwiseAND(
        ~PLACE).bitwiseOR(i.cast("bigint"))).alias("g"))
    least = F.array_distinct(F.transform(_range(F.size("g") - span + 1), lambda i: F.array_min(F.slice("g", i + 1, span))))
    return grams.select(*keep, F.explode(least).alias("f")).select(
        *keep, F.shiftright("f", PLACE_BITS).alias("hash"), F.col("f").bitwiseAND(PLACE).cast("int").alias("place"))


def short_grams(rows: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """(keep..., hash, place, length): all grams of the given lengths, for items shorter than a window."""
    hashed = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))

    def of(n: int) -> Column:
        return F.transform(_range(F.size("h") - n + 1), lambda i: F.struct(
            gram_hash(F.col("h"), i, n).alias("hash"), i.alias("place"), F.lit(n).alias("length")))

    grams = F.flatten(F.array(*map(of, lengths)))
    return hashed.select(*keep, F.inline(grams))


def _text(words: Column, at: Column, n: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, at + 1, n))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, words): items with at least one word."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    return shared_table(items, "items")


def find_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, tie, window_text, start, end): every window of a benchmark item that occurs in a document, at each place.

    ``tie`` is a hash of the text, so that rows with the same doc_id stay apart; equal rows give one result.
    """
    items = benchmark_windows(benchmark, item_id, item_text, window)
    key = [F.col(doc_id).alias("doc_id"), document_key(F.col(text)).alias("tie")]
    worded = docs.where(F.col(text).isNotNull()).select(*key, words_of(F.col(text)).alias("words"))
    spread = [F.col("doc_id"), F.col("tie")]

    known = shared_table(fingerprints(items, [], window, k).select("hash").distinct(), "prints")
    at = fingerprints(worded, ["doc_id", "tie"], window, k).join(broadcast_below(known, SMALL), "hash").select(
        *spread, "place", F.lit(window).alias("length"))
    short = [r[0] for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().orderBy("n").collect()]
    if short:  # at most window - 1 lengths
        grams = short_grams(items.where(F.size("words") < window), [], short).select("hash", "length").distinct()
        known_short = shared_table(grams, "shortprints")
        at = at.unionByName(short_grams(worded, ["doc_id", "tie"], short).join(broadcast_below(known_short, SMALL), ["hash", "length"]).select(
            *spread, "place", "length"))
    places = shared_table(at.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("place", "length")).alias("places")), "places")

    # The words around each common fingerprint: as many windows as can hold it, cut out where the text is.
    hit = _around(docs, key, places, text)
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.when(
        p["length"] < window, F.array(F.struct(p["place"].alias("start"), p["length"].alias("length")))).otherwise(F.transform(
            F.sequence(F.greatest(p["place"] - (window - k), F.lit(0)), F.least(p["place"], F.size("words") - window)),
            lambda s: F.struct(s.alias("start"), F.lit(window).alias("length")))))))
    windows = hit.select("doc_id", "tie", "words", starts.alias("starts")).select("doc_id", "tie", F.inline(F.transform(
        "starts", lambda s: F.struct(_text(F.col("words"), s["start"], s["length"]).alias("window_text"), s["start"].alias("start"),
                                     (s["start"] + s["length"]).alias("end")))))
    theirs = item_windows(items, window).select("window_text").distinct()
    return windows.join(theirs, "window_text")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window_text): all windows of the items; a shorter item is one window."""
    n = F.size("words")
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: _text(
        F.col("words"), i, window))).alias("window_text")).distinct()


def _around(docs: DataFrame, key: list[Column], places: DataFrame, text: str) -> DataFrame:
    """The words of documents with a candidate place; few places travel to the texts, many meet them in a shuffle."""
    numbers = places.select(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    small = F.broadcast(places) if numbers <= SMALL else places
    p = small.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "places")
    texts = docs.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("__text"))
    met = texts.join(p, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    return met.dropDuplicates(["doc_id", "tie"]).select("doc_id", "tie", words_of(F.col("__text")).alias("words"), "places")


def covered_words(spans: DataFrame) -> DataFrame:
    """(doc_id, tie, n_hit): how many words of a document lie in its spans."""
    return spans.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s")).select(
        "doc_id", "tie", F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to")))["n"].cast("bigint").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, tie, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of ``window`` words of an item (of a whole shorter item). A null
    text has no words; items without words or with a null id count for no item; repeated rows of ``docs`` each get the
    result; an empty benchmark hits nothing; other columns are not read.
    """
    spans = shared_table(find_spans(docs, benchmark, doc_id, text, item_id, item_text, window, k), "spans")
    covered = covered_words(spans)
    theirs = item_windows(benchmark_windows(benchmark, item_id, item_text, window), window)
    listed = spans.select("doc_id", "tie", "window_text").distinct().join(theirs, "window_text").groupBy("doc_id", "tie").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    both = covered.join(listed, covered["doc_id"].eqNullSafe(listed["doc_id"]) & (covered["tie"] == listed["tie"])).select(
        covered["doc_id"].alias("__id"), covered["tie"].alias("__tie"), "n_hit", "items")
    found = shared_table(both, "hits")
    sizes = docs.select(F.col(doc_id).alias("doc_id"), document_key(F.col(text)).alias("tie"),
                        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return sizes.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left").select(
        "doc_id", "tie", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
