import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F


from seamark.operators.blocks import asof_section, block_offsets, flatten_blocks, prepare_blocks, section_paths
from seamark.operators.chunking import (chunk_fixed, chunk_structure, fixed_passages, markdown_units, pack_units, sentence_units,
                                        structure_passages, window_spans)
from seamark.profiles import TextPreparation

CFG = TextPreparation("structure", 400, 80, 60)
MANUAL = """# Pump manual

The pump lifts water. It must be primed. Check the seal each week before you start the motor.

## 1. Motor

Use oil ISO VG 32. """ + "The motor turns at 1450 rpm in normal service. " * 20 + """

### 1.1 Torque

| Fastener | Torque |
|---|---|
""" + "".join(f"| Bolt M{i} number {i} of the housing | {i * 7} Nm |\n" for i in range(4, 24)) + """
## 2. Notes

Short note.
"""


def test_windows_cover_the_text_and_overlap():
    text = "".join(f"Sentence number {i} is here. " for i in range(400))
    spans = list(window_spans(text, 500, 80))
    assert all(e - s <= 500 for s, e in spans)
    assert set().union(*(range(s, e) for s, e in spans)) == set(range(len(text)))
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_windows_without_blanks():
    spans = list(window_spans("x" * 5000, 1000, 100))
    assert spans[0] == (0, 1000) and spans[-1][1] == 5000
    assert spans[1] == (900, 1900)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(4, 60), st.integers(0, 20))
def test_no_character_is_lost(text, limit, overlap):
    spans = list(window_spans(text, limit, min(overlap, limit // 2)))
    covered = set().union(*(range(s, e) for s, e in spans)) if spans else set()
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    assert all(e - s <= limit and text[s:e].strip() for s, e in spans)


def test_preferred_cut_points():
    assert list(window_spans("aaaaaa\n\nbbbbbbbb", 10, 0))[0] == (0, 8)
    assert list(window_spans("aaaaaa. bbbbbbbb", 10, 0))[0] == (0, 8)
    assert list(window_spans("aa bbbbbbbbbbbbb", 10, 0))[0] == (0, 10)  # the blank is in the first half


def test_sentences_have_true_offsets():
    text = "  One two. Three (four)! Five?\n\nNext \"par\". lower. \"Quoted\" end.\n \nLast"
    units = list(sentence_units(text))
    assert [u.text for u in units] == ["One two.", "Three (four)!", "Five?", 'Next "par". lower.', '"Quoted" end.', "Last"]
    assert all(text[u.start:u.end] == u.text for u in units)


def test_markdown_sections_and_tables():
    units = list(markdown_units(MANUAL))
    assert [u.text for u in units if u.heading] == ["# Pump manual", "## 1. Motor", "### 1.1 Torque", "## 2. Notes"]
    rows = [u for u in units if u.header]
    assert len(rows) == 21 and all(u.header == "| Fastener | Torque |" for u in rows)
    assert rows[0].section == "Pump manual › 1. Motor › 1.1 Torque"
    assert units[-1].section == "Pump manual › 2. Notes"


def test_structure_passages():
    passages = structure_passages(MANUAL, CFG)
    assert all(p.section for p in passages)
    assert all(len(p.content) <= 400 * 1.25 + len("| Fastener | Torque |\n") for p in passages)
    table = [p for p in passages if "Bolt M23" in p.content][0]
    assert table.content.startswith("| Fastener | Torque |\n")
    assert not any("1. Motor" in p.content and "2. Notes" in p.content for p in passages)
    body = " ".join(p.content for p in passages)
    assert all(f"Bolt M{i} " in body for i in range(4, 24)) and "ISO VG 32" in body and "Short note." in body
    same = [(a, b) for a, b in zip(passages, passages[1:]) if a.section == b.section]
    assert any(b.start < a.end for a, b in same)


def test_long_sentence_is_split():
    passages = structure_passages("# T\n\n" + "word " * 400, CFG)
    assert len(passages) > 2 and all(len(p.content) <= 400 for p in passages)


def test_heading_alone_is_dropped():
    assert structure_passages("# Only\n\n## Headings\n", CFG) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc ", min_size=1, max_size=30), st.sampled_from("xy")), max_size=40),
       st.integers(30, 60), st.integers(0, 15))
def test_packing_invariants(pieces, limit, overlap):
    from seamark.operators.chunking import Unit
    units, at = [], 0
    for text, section in pieces:
        units.append(Unit(at, at + len(text), text, section))
        at += len(text) + 1
    cfg = TextPreparation("structure", limit, min(overlap, limit // 2), limit // 4)
    passages = pack_units(units, cfg)
    bounds = [(u.start, u.end, u.section) for u in units if u.text.strip()]
    for start, end, section in bounds:  # every unit is inside a passage of its own section
        assert any(p.start <= start and p.end >= end and p.section == section for p in passages)
    assert all(len(p.content) <= int(limit * 1.25) + 1 for p in passages)
    assert all(a.start < b.start and a.end < b.end for a, b in zip(passages, passages[1:]))


def test_chunk_jobs_equal_the_kernels(spark):
    texts = [(i, MANUAL.replace("Pump", f"Pump {i}") if i % 2 else "plain text. " * (i * 30)) for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    fixed = {(r.doc_id, r.start, r.end) for r in chunk_fixed(df, "text", 300, 50).collect()}
    assert fixed == {(i, s, e) for i, t in texts if t for s, e in window_spans(t, 300, 50)}
    packed = {(r.doc_id, r.start, r.content) for r in chunk_structure(df, "text", CFG).collect()}
    assert packed == {(i, p.start, p.content) for i, t in texts if t for p in structure_passages(t, CFG)}


BLOCKS = [("d", 0, "heading", 0, "Manual", None), ("d", 1, "heading", 1, "Care", None),
          ("d", 2, "paragraph", None, "Clean it. Dry it.", None), ("d", 3, "row", None, None, ["Task", "Interval"]),
          ("d", 4, "row", None, None, ["Oil", "Oil", "1 year"]), ("d", 5, "row", None, None, ["", ""]),
          ("d", 6, "heading", 2, "Deep", None), ("d", 7, "paragraph", None, "Text below.", None),
          ("d", 8, "heading", 1, "End", None), ("d", 9, "paragraph", None, "Bye.", None)]


def test_blocks(spark):
    df = spark.createDataFrame(BLOCKS, "doc_id string, seq int, kind string, level int, text string, cells array<string>")
    lines = block_offsets(flatten_blocks(df))
    rows = {r.seq: r for r in section_paths(lines).collect()}
    full = "Manual\n\nCare\n\nClean it. Dry it.\n\nTask | Interval\nOil | 1 year\n\nDeep\n\nText below.\n\nEnd\n\nBye."
    assert all(full[r.start:r.end] == r.text for r in rows.values()) and 5 not in rows
    assert rows[7].section == "Manual › Care › Deep" and rows[9].section == "Manual › End" and rows[4].section == "Manual › Care"
    packed = prepare_blocks(df, TextPreparation("structure", 30, 0, 0)).orderBy("start").collect()
    assert any(r.content.startswith("Task | Interval\nOil") for r in packed)
    assert [r.section for r in packed][-1] == "Manual › End"
    fixed = prepare_blocks(df, TextPreparation("fixed", 40, 5)).orderBy("start").collect()
    assert all(full[r.start:r.end].strip() == r.content for r in fixed) and fixed[0].section == "Manual"


@pytest.mark.parametrize("hot", [False, True])
def test_asof_section_against_a_scan(spark, hot):
    rng = random.Random(5)
    docs = ["a"] * 40 + (["b"] * 5 if not hot else [])
    segments = [(d, i, rng.randrange(200_000)) for i, d in enumerate(docs)]
    headings = [(d, o, f"h{o}") for d in sorted(set(docs)) for o in sorted(rng.sample(range(200_000), 12))]
    got = {(r.doc_id, r.segment_id): r.section for r in asof_section(
        spark.createDataFrame(segments, "doc_id string, segment_id int, start int"),
        spark.createDataFrame(headings, "doc_id string, off int, title string")).collect()}
    for d, i, start in segments:
        before = [t for hd, o, t in headings if hd == d and o <= start]
        assert got[(d, i)] == (before[-1] if before else None)


def test_kernels_hold_a_bounded_piece_of_a_batch(spark):
    """Chunking and embedding work through a batch in pieces of text, and lose or change no row by it."""
    import pyarrow as pa
    from seamark.functions import text as texts
    from seamark.operators.embedding import HashEmbedder, embed
    values = ["a" * n for n in (0, 700, 700, 5000, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(values)], names=["id", "text"])
    cut = list(texts.pieces(batch, "text", 1000))
    assert [i for p in cut for i in p.column(0).to_pylist()] == list(range(7)) and len(cut) >= 3
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) for p in cut) <= 1400
    assert list(texts.pieces(batch.slice(0, 0), "text")) == []
    df = spark.createDataFrame([(i, "word " * 200) for i in range(60)], "id int, input string").coalesce(1)
    assert embed(df, HashEmbedder).where("token_count = 200").count() == 60
    got = sorted((r.id, r.start, r.end) for r in chunk_fixed(df, "input", 300, 0).select("id", "start", "end").collect())
    assert got == sorted((i, p.start, p.end) for i in range(60) for p in fixed_passages("word " * 200, TextPreparation("fixed", 300, 0)))


def test_a_table_of_few_files_is_dealt_by_its_size(spark, tmp_path, monkeypatch):
    """A task gets so many bytes of text, however large the table is: not a share of it by the number of cores."""
    from seamark import session
    cores = spark.sparkContext.defaultParallelism
    spark.range(200).select("id", F.lpad(F.col("id").cast("string"), 100, "ab ").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    assert chunk_fixed(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "DEALT_BYTES", 500)
    many = chunk_fixed(df)
    assert many.rdd.getNumPartitions() == 40 > cores and many.count() == 200
