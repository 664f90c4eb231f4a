import random
import re

from pyspark.sql import functions as F

from inkloom.operators import segment
from inkloom.sources import files


def words(s):
    return len(re.findall(r"\b[\w'’-]+\b", s))


def test_headings(spark):
    yes = ["Chapter 3", "BOOK IV", "Part Nine", "Epilogue", "Forty-Two", "SEVEN", "THIRTY-SIX", "207", "XXI", "Fifty"]
    no = ["They reached part two of the road.", "20711", "xxi", "Fifty-Three", ""]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", segment.is_heading(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {t: t in yes for t in yes + no}
    stop = spark.createDataFrame([("About theAuthors",), ("BIBLIOGRAPHY",), ("about the harbour",)], "t string").select(segment.is_stop_heading(F.col("t")))
    assert [r[0] for r in stop.collect()] == [True, True, False]
    wide = spark.createDataFrame([("Dawn\n\nText.",), ("chapter xii",), ("Two words",), ("",), (None,)], "t string").select(segment.opens_chapter(F.col("t")))
    assert [r[0] for r in wide.collect()] == [True, True, False, False, False]


def test_split_pages(spark):
    df = spark.createDataFrame([(1, "﻿one\ftwo\f\n"), (2, ""), (3, "a\r\nb")], "b long, t string")
    got = [(r["b"], r["page"], r["text"]) for r in segment.split_pages(df, "b", "t").orderBy("b", "page").collect()]
    assert got == [(1, 1, "one"), (1, 2, "two"), (2, 1, ""), (3, 1, "a\nb")]


def test_continuation(spark):
    pages = [(1, 1, "The tide kept rising"), (1, 2, "over the lower steps.\n\n"), (1, 3, "Nobody slept."), (2, 1, "FOUR"), (2, 2, "Gulls."), (3, 1, None), (3, 2, "x"), (3, 3, ""), (3, 4, "y"), (3, 5, "Chapter 2")]
    df = spark.createDataFrame(pages, "b long, page int, text string")
    got = {(r["b"], r["page"]): r["continues"] for r in segment.continuation(df, "b", "page", "text", "text").collect()}
    # An empty page is no heading and doesn't end a paragraph.
    assert {k for k, v in got.items() if v} == {(1, 2), (3, 2), (3, 3), (3, 4)} and len(got) == len(pages)


def test_positioned_paragraphs(spark):
    rows = [
        (1, 1, "ABC Amber LIT Converter", 10.0, 1.0), (1, 2, "A gate was o-", 93.0, 100.0), (1, 3, "pened.", 90.0, 114.0), (1, 4, "Nobody came.", 93.0, 142.0),
        (2, 1, "no end mark", 93.0, 100.0), (2, 2, "goes on.", 93.0, 128.0), (2, 3, "New one.", 93.0, 156.0),
    ]
    df = spark.createDataFrame(rows, "page int, line_no int, text string, x0 double, top double")
    got = [(r["page"], r["text"], r["continues"]) for r in segment.positioned_paragraphs(df, ["page"]).orderBy("page", "para").collect()]
    assert got == [(1, "A gate was opened.", False), (1, "Nobody came.", False), (2, "no end mark goes on.", False), (2, "New one.", False)]


def chunks(spark, pages, target, most):
    df = spark.createDataFrame([(1, *p) for p in pages], "b long, page int, text string")
    limits = spark.createDataFrame([(1, target, most)], "b long, t int, m int")
    return segment.chunk_books(df, "b", limits, "t", "m").orderBy("chunk_index").collect()


def test_page_continuation_is_joined(spark):
    got = chunks(spark, [(4, "The lamp was pas-"), (5, "sed along the wall.\n\nThen it went out.\n\n"), (6, "")], 100, 100)
    assert [(r["source"], r["page_start"], r["page_end"]) for r in got] == [("The lamp was passed along the wall.\n\nThen it went out.", 4, 5)]


def test_heading_opens_a_chunk_and_stop_heading_ends_the_book(spark):
    got = chunks(spark, [(1, "Eight\n\nRain.\n\n"), (2, "Nine\n\nSnow fell.\n\nAbout the Author\n\nGone."), (3, "Gone too.")], 100, 100)
    assert [r["source"] for r in got] == ["Eight\n\nRain.", "Nine\n\nSnow fell."]
    assert [r["chunk_id"] for r in got] == ["chunk-0001", "chunk-0002"]


def test_books_keep_their_own_limits(spark):
    text = " ".join(f"Word{i} goes on." for i in range(60)) + "\n\n" + " ".join(["long"] * 50) + "."
    df = spark.createDataFrame([(b, 1, text) for b in (1, 2, 3)] + [(None, 1, text), (4, 1, None)], "b long, page int, text string")
    limits = spark.createDataFrame([(1, 20, 30), (2, 500, 600), (4, 5, 5)], "b long, t int, m int")
    got = segment.chunk_books(df, "b", limits, "t", "m").collect()
    by = {b: [r for r in got if r["b"] == b] for b in (1, 2)}
    assert {r["b"] for r in got} == {1, 2} and len(by[2]) == 1
    assert all(words(r["source"]) == r["source_words"] <= 30 for r in by[1]) and len(by[1]) >= 8
    assert [r["chunk_index"] for r in sorted(by[1], key=lambda r: r["chunk_index"])] == list(range(1, len(by[1]) + 1))
    assert " ".join(" ".join(r["source"] for r in sorted(by[1], key=lambda r: r["chunk_index"])).split()) == " ".join(text.split())


def greedy(units, target, most):
    out, now = [], []
    for u in units:
        n = sum(map(words, now))
        if now and (n + words(u) > most or n >= target):
            out.append(now)
            now = []
        now.append(u)
    return out + ([now] if now else [])


def test_greedy_filling_equals_a_plain_loop(spark):
    rng = random.Random(5)
    paragraphs = [" ".join("w" for _ in range(rng.randint(1, 30))) + "." for _ in range(80)]
    pages = [(i + 1, "\n\n".join(paragraphs[i * 8 : i * 8 + 8]) + "\n\n") for i in range(10)]
    got = chunks(spark, pages, 40, 60)
    assert [r["source"].split("\n\n") for r in got] == greedy(paragraphs, 40, 60)
    assert all(r["source_words"] <= 60 for r in got)


def test_sentence_units(spark):
    text = "Red sails came. None saw them. " + " ".join(["W"] * 12) + ". Night fell again."
    got = spark.createDataFrame([(text,)], "t string").select(segment.sentence_units(F.col("t"), F.lit(6))).first()[0]
    assert got[0] == "Red sails came. None saw them." and " ".join(got).split() == text.split()
    assert all(len(u.split()) <= 6 for u in got)


def test_lines_of_a_reader_as_pages(spark):
    rows = [(1, 1, "Old walls", 93.0, 10.0), (1, 2, "stood.", 80.0, 24.0), (1, 3, "Moss grew.", 93.0, 60.0), (2, 1, "and fell.", 80.0, 10.0)]
    df = spark.createDataFrame(rows, "page int, line_no int, text string, x0 double, top double")
    got = [(r["page"], r["text"], r["continues"]) for r in files.read_lines(df, ["page"]).orderBy("page").collect()]
    assert got == [(1, "Old walls stood.\n\nMoss grew.", False), (2, "and fell.", True)]
