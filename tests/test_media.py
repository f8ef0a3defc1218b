import random
from pathlib import Path

from seamark.operators.media import group_transcript, soundtrack_windows, time_windows
from seamark.operators.pages import assemble_ocr, prepare_pages
from seamark.operators.prepare import prepare, with_ordinals
from seamark.profiles import PROFILES, MediaPreparation, PagePreparation, TextPreparation


def windows(spark, duration, seconds, overlap=0.0):
    df = spark.createDataFrame([("m", float(duration))], "media_id string, duration double")
    return [(r.start_seconds, r.end_seconds) for r in time_windows(df, seconds, overlap).orderBy("window_no").collect()]


def test_time_windows(spark):
    assert windows(spark, 65, 30.0, 5.0) == [(0, 30), (25, 55), (50, 65)]
    assert windows(spark, 56, 30.0, 5.0) == [(0, 30), (25, 56)]
    assert windows(spark, 65, 30.0) == [(0, 30), (30, 60), (60, 65)]
    assert windows(spark, 30, 30.0, 5.0) == [(0, 30)]
    assert windows(spark, 60.04, 30.0) == [(0, 30), (30, 60)]
    assert windows(spark, 0.04, 30.0) == []
    assert windows(spark, 12, 30.0, 5.0) == [(0, 12)]


def test_soundtrack_needs_a_second_of_sound(spark):
    df = spark.createDataFrame([("a", 40.0, 0.9), ("b", 40.0, 1.0)], "media_id string, duration double, audio_seconds double")
    rows = soundtrack_windows(df, MediaPreparation(30.0, 5.0)).collect()
    assert {r.media_id for r in rows} == {"b"} and {r.kind for r in rows} == {"soundtrack"}


def greedy(lines, limit):
    passages, used = [], 0
    for line in lines:
        if passages and used + len(line) <= limit:
            passages[-1].append(line)
            used += len(line)
        else:
            passages.append([line])
            used = len(line)
    return [" ".join(x.strip() for x in p) for p in passages]


def test_transcript_pieces_equal_one_walk(spark):
    """One medium holds most lines and is cut into many pieces; the result is that of one pass over it."""
    rng = random.Random(3)
    media = {"hot": [("w" * rng.randrange(1, 9)) + rng.choice(["", " "]) for _ in range(1500)],
             "cold": ["x" * rng.randrange(1, 60) for _ in range(40)], "one": ["hello"]}
    rows = [(m, i, i * 1.0, i + 0.5, t, 0.1) for m, ts in media.items() for i, t in enumerate(ts)]
    rows += [("one", 1, 1.0, 1.5, "noise", 0.7), ("one", 2, 2.0, 2.5, "  ", 0.0)]
    df = spark.createDataFrame(rows, "media_id string, line_no int, start double, end double, text string, no_speech_prob double")
    got = group_transcript(df, 20, piece_lines=50).collect()
    for name, lines in media.items():
        mine = [r.content for r in sorted((r for r in got if r.media_id == name), key=lambda r: r.start_seconds)]
        assert mine == greedy(lines, 20)
    assert sum(r.lines for r in got) == sum(map(len, media.values()))


def test_ocr_reading_order(spark):
    rows = [("p", 50.0, 10.0, "b", 0.9), ("p", 5.0, 13.0, "a", 0.9), ("p", 1.0, 40.0, "c", 0.6), ("p", 0.0, 0.0, "no", 0.5)]
    df = spark.createDataFrame(rows, "page_id string, x double, y double, text string, confidence double")
    assert assemble_ocr(df).first().text == "a\nb\nc"


def test_pages(spark):
    words = "Recognised words of a scanned page. " * 3
    rows = [("d", 1, "A page with enough text to be cut.\r\nNext line.", None), ("d", 2, " ", words), ("d", 3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, ocr_text string")
    got = prepare_pages(df, PagePreparation(20, True), TextPreparation("fixed", 400, 50)).collect()
    assert sorted((r.page, r.modality, r.kind or "") for r in got) == [
        (1, "text", ""), (2, "image", ""), (2, "text", "ocr"), (3, "image", "")]
    assert [r.content for r in got if r.page == 1] == ["A page with enough text to be cut.\nNext line."]
    assert len(prepare_pages(df, PagePreparation(20, False), TextPreparation()).collect()) == 3


def test_prepare_routes_and_reports(spark):
    files = [("t", "text/plain", b"\xef\xbb\xbfHello there. General."), ("bad", "text/plain", b"\xff\xfe\xfa"),
             ("nul", "text/markdown", b"a\x00b"), ("blank", "text/plain", b" \n\t"), ("img", "image/png", b"1"),
             ("odd", "application/x-msdownload", b"1"), ("a", "audio/wav", b"1"), ("v", "video/mp4", b"1"),
             ("mute", "audio/mpeg", b"1"), ("pdf", "application/pdf", b"1")]
    df = spark.createDataFrame(files, "version_id string, media_type string, content binary")
    media = spark.createDataFrame([("a", 40.0, 40.0), ("v", 30.0, 12.0)], "media_id string, duration double, audio_seconds double")
    pages = spark.createDataFrame([("pdf", 1, "x", "Words that were read from the picture.")],
                                  "doc_id string, page int, text string, ocr_text string")
    spoken = spark.createDataFrame([("v", 0, 0.0, 1.0, "hello", 0.1), ("a", 0, 0.0, 1.0, "hi", 0.1)],
                                   "media_id string, line_no int, start double, end double, text string, no_speech_prob double")
    segments, outcomes = prepare(df, PROFILES["p4"], pages=pages, media=media, transcript=spoken)
    assert {r.version_id: r.error_code for r in outcomes.collect()} == {
        "bad": "UNREADABLE", "nul": "UNREADABLE", "blank": "EMPTY_CONTENT", "odd": "FORMAT_UNSUPPORTED", "mute": "EMPTY_CONTENT"}
    rows = with_ordinals(segments, "p4").collect()
    order = {v: [(r.modality, r.kind) for r in sorted((r for r in rows if r.version_id == v), key=lambda r: r.ordinal)]
             for v in ("t", "img", "a", "v", "pdf")}
    assert order["t"] == [("text", None)] and order["img"] == [("image", None)]
    assert order["a"] == [("audio", None), ("audio", None), ("text", "transcript")]
    assert order["v"] == [("video", None), ("video", None), ("audio", "soundtrack"), ("text", "transcript")]
    assert order["pdf"] == [("image", None), ("text", "ocr")]
    assert [r.content for r in rows if r.version_id == "t"] == ["Hello there.\nGeneral."]


def test_prepare_outcomes_agree_with_sql_where_texts_are_blank(spark, tmp_path):
    import shutil
    import duckdb
    from compare import connect, difference
    from seamark.plans.catalog import ORACLES, QUERIES
    for source in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(source, tmp_path / source.name)
    odd = "(100000, '', 'en', 'src1', 0), (100005, ' ', 'en', 'src2', 1), (100001, NULL, 'de', 'src3', 20), (100002, '# title', 'de', 'src3', 15), " \
          "(100003, 'x', 'en', 'src1', 6), (100003, 'x', 'en', 'src1', 6)"  # texts without passages, and a repeated row
    duckdb.sql(f"COPY (FROM '/root/testdata/sf0.001/documents.parquet' UNION ALL FROM (VALUES {odd}) t) TO '{tmp_path}/documents.parquet'")
    assert difference(spark, connect(str(tmp_path)), "prepare_outcomes", str(tmp_path), QUERIES, ORACLES) is None
