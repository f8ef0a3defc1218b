"""License scans by diagonal voting, in DataFrame functions only.

Every ``K``-word gram of a text meets the templates' grams in a join; a hit at word i of the text and j of a template
votes for the diagonal i - j. A phrase stands where one diagonal has all its votes. For notices, which are often edited,
neighbouring diagonals that follow each other in the text are merged. A merged span is then compared with its notice word
by word along its diagonals; it counts by the share of the notice's words that stand in it, each counted once, if it is not
much longer than the notice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.llm.common import broadcast_below, document_key, literal_rows, shared_table
from seamark.llm.decontamination import _range, gram_hash, words_of

K = 3
SHIFT = 6      # words that may be added or left out between merged diagonals
COVER = 0.6    # share of a notice's words that a span must have
MAX_WORDS = 1_000_000  # of all templates, which are broadcast
SMALL = 100_000        # spans that may be broadcast, some hundred bytes each
STRETCH = 1.5  # how much longer than the notice a span may be

# Phrases that decide alone (text, label).
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Openings of well-known licence notices (text, label).
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
]


def template_table(spark, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(template, label, phrase, text) of given lists; :func:`scan` takes any such table, with whole licence texts too."""
    rows = [(k, label, k < len(phrases), text) for k, (text, label) in enumerate([*phrases, *notices])]
    return literal_rows(spark, ["template", "label", "phrase", "text"], rows)


def template_grams(library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((template, label, phrase, n, j, g), (template, words)): grams and words of all templates, checked to be few."""
    worded = library.select("template", "label", "phrase", words_of(F.col("text")).alias("words"))
    size = worded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n"), F.min(F.size("words")).alias("least")).first()
    if size["n"] > MAX_WORDS or (size["least"] is not None and size["least"] < K):
        raise ValueError(f"templates have {K} words at least and {MAX_WORDS} together at most")
    hashed = worded.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = F.transform(_range(F.size("h") - K + 1), lambda i: F.struct(i.alias("j"), gram_hash(F.col("h"), i, K).alias("g")))
    return F.broadcast(hashed.select("template", "label", "phrase", (F.size("h") - K + 1).alias("n"), F.inline(grams))), F.broadcast(
        worded.select("template", F.col("words").alias("own")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", library: DataFrame | None = None) -> DataFrame:
    """(doc_id, tie, template, label, phrase, start, end, cover): where phrases and notices stand, in words from 0.

    ``library(template, label, phrase, text)`` holds the templates (``template_table`` if not given). ``tie`` is a hash of
    the text that keeps rows with one doc_id apart; equal rows give one result. Spans with less than ``COVER`` of their
    notice are left in with their ``cover``; phrases are whole or absent.
    """
    grams_of, words_in = template_grams(template_table(docs.sparkSession) if library is None else library)
    key = [F.col(doc_id).alias("doc_id"), document_key(F.col(text)).alias("tie")]
    told = docs.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("told"))
    grams = told.select("doc_id", "tie", words_of(F.col("told")).alias("words")).select("doc_id", "tie", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).select(
        "doc_id", "tie", F.posexplode(F.transform(_range(F.size("h") - K + 1), lambda i: gram_hash(F.col("h"), i, K))).alias("i", "g"))
    hits = grams.join(grams_of, "g").select("doc_id", "tie", "template", "label", "phrase", "n", "i", "j", (F.col("i") - F.col("j")).alias("diagonal"))
    own = ["doc_id", "tie", "template", "label", "phrase", "n"]
    votes = shared_table(hits.groupBy(*own, "diagonal").agg(F.collect_set("j").alias("js"), F.min("i").alias("lo"),
                                                            F.max("i").alias("hi")), "votes")  # hits only, read twice
    placed = votes.where(F.col("phrase") & (F.size("js") == F.col("n"))).select(
        "doc_id", "tie", "template", "label", "phrase", F.col("lo").alias("start"), (F.col("hi") + K).alias("end"), F.lit(1.0).alias("cover"))
    along = W.partitionBy("doc_id", "tie", "template").orderBy("lo", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > SHIFT) | (
        F.col("lo") - F.lag("hi").over(along) > K + SHIFT) | F.lag("lo").over(along).isNull()
    runs = votes.where("not phrase").withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(
        along.rowsBetween(W.unboundedPreceding, 0)))
    # the places of a template's words under each diagonal of a run: at most its words, times the run's diagonals
    covered = F.array_distinct(F.flatten(F.transform("js", lambda j: F.transform(_range(F.lit(K)), lambda o: j + o))))
    places = F.transform(covered, lambda p: F.struct(p.alias("p"), (p + F.col("diagonal")).alias("i")))
    merged = shared_table(runs.groupBy(*own, "run").agg(F.flatten(F.collect_list(places)).alias("places"), F.min("lo").alias("start"),
                                           (F.max("hi") + K).alias("end")).where(
        F.col("end") - F.col("start") <= STRETCH * (F.col("n") + K - 1) + SHIFT), "spans")
    # texts stay where they are read: the spans, with the places of their words, are sent to them if they are few
    named = broadcast_below(merged.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"}), SMALL)
    compared = told.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))).join(words_in, "template").withColumn("words", words_of(F.col("told")))
    same = F.filter("places", lambda x: F.get(F.col("words"), x["i"]) == F.get(F.col("own"), x["p"]))
    cover = F.size(F.array_distinct(F.transform(same, lambda x: x["p"]))) / F.size("own")
    spans = compared.select("doc_id", "tie", "template", "label", "phrase", "start", "end", cover.alias("cover")).distinct()
    return placed.unionByName(spans)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", library: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest cover of any template, 0 without a hit. A null or empty text has no words and no labels;
    repeated rows each get the result; an empty table gives no rows; other columns are not read.
    """
    found = scan(docs, doc_id, text, library)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    counted = found.groupBy("doc_id", "tie").agg(
        F.sum(F.col("phrase").cast("bigint")).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("last_word"),
        listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        listed(F.when(F.col("phrase") | (F.col("cover") >= COVER), F.col("label"))).alias("labels"),
        F.max("cover").alias("score")).withColumnsRenamed({"doc_id": "__id", "tie": "__tie"})
    sizes = docs.select(F.col(doc_id).alias("doc_id"), document_key(F.col(text)).alias("tie"),
                        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    return sizes.join(counted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
