import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from inkloom.operators import quality
from inkloom.sources import files
from inkloom.streaming import windows


def test_text_pages_and_line_bounds(spark, tmp_path):
    path = tmp_path / "book.txt"
    path.write_text("teaser\n\f\nONE\n\nStory.\f\nTWO\n\nMore.\f\nABOUT", encoding="utf-8")
    pages = files.read_text_pages(spark, str(path), 2, 3).orderBy("page").collect()
    assert [r["page"] for r in pages] == [2, 3]
    lines = files.read_text_pages(spark, str(path), first_line=3, last_line=7).orderBy("page").collect()
    assert [(r["page"], r["text"].strip()) for r in lines] == [(2, "ONE\n\nStory."), (3, "TWO")]


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"chunk_id": "chunk-0001", "index": 1, "source": "a"}\n\n{broken\n{"chunk_id": "chunk-0002"}\n', encoding="utf-8")
    good, bad = files.read_jsonl(spark, str(path))
    assert sorted((r["line_no"], r["chunk_id"]) for r in good.collect()) == [(1, "chunk-0001"), (4, "chunk-0002")]
    assert [(r["line_no"], r["line"]) for r in bad.collect()] == [(3, "{broken")]


def test_jsonl_numbers_lines_across_splits(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("".join("{bad\n" if i % 50 == 7 else "\n" if i % 50 == 9 else '{"chunk_id": "c%d", "source": "%s"}\n' % (i, "x" * 200) for i in range(1, 401)), encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        good, bad = files.read_jsonl(spark, str(path))
        assert good.filter("chunk_id <> concat('c', line_no)").count() == 0 and good.count() == 400 - 16
        assert sorted(r["line_no"] for r in bad.collect()) == [i for i in range(1, 401) if i % 50 == 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_written_lines_hashes_and_artifacts(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "é", None)], "a int, b string, c string").coalesce(1), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part*")] == ['{"a":1,"b":"é","c":null}\n']
    for name, body in (("b.json", "{}"), ("a.json", "[1]"), ("c.json", "{x")):
        (tmp_path / name).write_text(body)
    got = [(r["name"], r["invalid"]) for r in files.read_artifacts(spark, str(tmp_path / "*.json")).collect()]
    assert got == [("a.json", True), ("b.json", False), ("c.json", True)]
    assert files.file_hashes(spark, str(tmp_path / "b.json")).first()["sha256"] == hashlib.sha256(b"{}").hexdigest()
    (tmp_path / "t.txt").write_text("a\fb\fc\n\f")
    assert files.text_metadata(spark, str(tmp_path / "t.txt")).first()["pages"] == 3
    assert files.source_kind({"source_file": "x/B.PDF"}) == ("x/B.PDF", "pdf") and files.source_kind({"source_text": "a", "source_pdf": "b"}) == ("a", "text")
    with pytest.raises(ValueError):
        files.source_kind({})
    quality.write_report(spark.createDataFrame([("a", "1", "x"), ("a", "2", None)], quality.ISSUE), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "checks")).first()["n"] == 2


def test_registry(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text('source_term,target_term,category,status,first_chunk,notes\na,甲,place,Approved,chunk-0001,"x, ""y"""\nb,乙,,provisional,,\n', encoding="utf-8-sig")
    rows = files.read_registry(spark, str(path))
    assert [r["source_term"] for r in rows.orderBy("source_term").collect()] == ["a", "b"] and rows.filter("source_term = 'a'").first()["notes"] == 'x, "y"'
    assert files.read_registry(spark, str(path), only_approved=True).count() == 1
    assert files.read_registry(spark, str(tmp_path / "none.csv")).count() == 0
    merged = files.append_registry(rows, rows.limit(1).unionByName(rows.limit(1).withColumn("source_term", F.lit("c"))), ["source_term"], str(tmp_path / "new"))
    assert merged.count() == 3


def test_terminology_and_fields(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"terms": [{"source_term": "a", "target_term": "甲"}],\n "characters": [{"source_name": "B", "target_name": "乙", "aliases": "x|y"}]}', encoding="utf-8")
    assert [(r["source_term"], r["category"]) for r in files.read_terminology(spark, str(path)).collect()] == [("a", None), ("B", "character")]
    df = spark.createDataFrame([("- Title: The Book\n- ISBN: \nText",)], "t string")
    assert files.read_fields(df, "t", ["Title", "ISBN", "None"]).select("Title", "ISBN", "None").first()[:] == ("The Book", None, None)


def test_write_once(spark, tmp_path):
    path = files.write_once(spark.range(3).toDF("x"), str(tmp_path), "abc")
    files.write_once(spark.range(9).toDF("x"), str(tmp_path), "abc")
    assert spark.read.parquet(path).count() == 3


def test_page_statistics(spark):
    df = spark.createDataFrame([(1, "x" * n) for n in (10, 90, 100, 200)] + [(2, None), (2, "x" * 10)], "b long, t string")
    got = {r["b"]: r for r in files.page_statistics(df, ["b"], "t").collect()}
    assert (got[1]["median_characters"], got[1]["low_pages"], got[1]["likely_scanned"]) == (100, 1, False)
    assert (got[2]["median_characters"], got[2]["characters"], got[2]["likely_scanned"]) == (10, 10, True)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, dt.datetime(2026, 1, 1, i % 3, 30), i % 2, "a" if i % 4 else "b", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.unionByName(df.limit(2)).coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, windows.read_folder(spark, str(tmp_path / "in"), df.schema)


def test_windowed_counts(spark, tmp_path, events):
    df, stream = events
    windows.run_to_table(windows.windowed_counts(stream, "ts", "event_type", "value"), "counts", "complete", str(tmp_path / "c1"))
    assert sum(r["n"] for r in spark.table("counts").collect()) == 14


def test_first_copies_and_totals(spark, tmp_path, events):
    df, stream = events
    unique = windows.first_copies(stream, ["event_id"], "ts")
    windows.run_to_table(unique, "firsts", "append", str(tmp_path / "c2"))
    assert spark.table("firsts").count() == 12
    windows.run_to_table(windows.keyed_totals(stream, "user_id", "ts", "event_type", "value"), "totals", "update", str(tmp_path / "c3"))
    got = {r["key"]: r for r in spark.table("totals").collect()}
    assert got[0]["seen"] + got[1]["seen"] == 14 and got[0]["total"] + got[1]["total"] == sum(range(12)) + 1


def test_durations():
    assert [windows.milliseconds(x) for x in ("30 minutes", "2 hours", "1 day", "5 seconds", "250 ms")] == [1_800_000, 7_200_000, 86_400_000, 5_000, 250]
