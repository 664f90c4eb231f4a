import pytest
from pyspark.sql import functions as F

from inkloom.operators import context

CHUNK = "b long, chunk_key long, chunk_id string, chunk_index int, page_start int, page_end int, source string, at int"


def chunks(spark, sources):
    return spark.createDataFrame([(1, i, f"chunk-{i:04d}", i, i, i + 1, s, 0) for i, s in enumerate(sources, 1)], CHUNK)


def test_neighbours(spark):
    got = context.neighbours(chunks(spark, ["one", "two", "three"]), "b", ["chunk_index"], "source", 2, 4).orderBy("chunk_index").collect()
    assert [(r["before_text"], r["after_text"]) for r in got] == [(context.OPENING, "two"), ("ne", "thre"), ("wo", context.ENDING)]


def test_transitions(spark):
    got = context.transitions(chunks(spark, ["a", "b", "Two\n\nc", None]), "b", ["chunk_index"], "source").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["previous_end"]) for r in got] == [(1, None), (3, "b")]


def test_latest_and_choose(spark):
    df = spark.createDataFrame([(1, 1, "old", 3), (1, 2, "new", 1), (2, None, "only", 2), (3, 1, None, 1), (3, 1, "x", 2)], "k long, at int, v string, rank int")
    assert sorted((r["k"], r["v"]) for r in context.latest(df.filter("k < 3"), ["k"], ["at"]).collect()) == [(1, "new"), (2, "only")]
    assert sorted((r["k"], r["v"]) for r in context.choose(df, ["k"], "rank", "v").collect()) == [(1, "new"), (2, "only"), (3, "x")]


def test_assembly_round_trip(spark):
    books = context.assemble(chunks(spark, ["one", None, "three "]), "b")
    text = books.first()["book_text"]
    assert text == "<!-- chunk-0001; source pages 1-2 -->\n\none\n\n<!-- chunk-0003; source pages 3-4 -->\n\nthree\n"
    assert [(r["pos"], r["chunk_id"]) for r in context.markers(books, "b", "book_text").orderBy("pos").collect()] == [(1, "chunk-0001"), (2, "chunk-0003")]


def test_contiguity_and_groups(spark):
    df = chunks(spark, ["a", "b", "c"]).filter("chunk_index <> 2")
    assert [(r["chunk_index"], r["expected"]) for r in context.contiguity(df, "b", "chunk_index", "chunk_id").collect()] == [(3, 2)]
    five = spark.range(1, 6).select(F.lit(1).alias("b"), "id")
    assert [r["batch_no"] for r in context.groups_of(five, ["b"], ["id"], 2).orderBy("id").collect()] == [1, 1, 2, 2, 3]


def test_selection_lookup_and_opening(spark):
    df = spark.createDataFrame([(1, i, f"chunk-{i:04d}", "ab" * i) for i in range(1, 6)] + [(2, 1, "x", None)], "b long, i int, k string, t string")
    one = df.filter("b = 1")
    assert [r["i"] for r in context.selected(one, "i", 2, 4, 2).collect()] == [2, 3] and context.selected(one, "i").count() == 5
    assert context.piece(one, "k", "chunk-0003").first()["i"] == 3
    with pytest.raises(KeyError):
        context.piece(one, "k", "chunk-0009")
    got = {r["b"]: r["opening"] for r in context.opening(df, "b", "i", "t", 3, 12).collect()}
    assert got == {1: "ab\n\nabab\n\nab", 2: ""}
