from pyspark.sql import functions as F

from inkloom.operators import terms

SCAN = "book_id long, chunk_id string, source_term string, proposed_target string, category string, confidence string, notes string, at int"


def test_ascii_boundaries(spark):
    rows = [("Gulls overhead.", "head", False), ("Her head hurt.", "HEAD", True), ("éhead", "head", True), ("un éLAN fou", "ÉLAN", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("a\\Eb c", "c", True)]
    df = spark.createDataFrame(rows, "t string, w string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", terms.contains_term(F.col("t"), F.col("w"))).collect())


def test_matches_of_many_terms(spark):
    rows = [(1, 1, "Her head hurt at the Gate."), (2, 1, "overhead gates"), (3, 2, "head"), (4, 1, None), (5, 1, "ΟΔΟΣ and Straße")]
    texts = spark.createDataFrame(rows, "k long, b long, t string")
    words = [(1, "HEAD", "甲"), (1, "gate", "乙"), (1, "gate", "丙"), (1, " ", "x"), (1, None, "x"), (1, "οδος", "丁"), (1, "strasse", "戊"), (None, "head", "x")]
    listed = spark.createDataFrame(words, "b long, w string, g string")
    got = sorted((r["k"], r["g"]) for r in terms.term_matches(texts, listed, "b", "t", "w").collect())
    assert got == [(1, "丙"), (1, "乙"), (1, "甲"), (5, "丁")]
    got = sorted((r["k"], r["g"]) for r in terms.term_matches(texts, listed, "b", "t", "w", whole=False).collect())
    assert got == [(1, "丙"), (1, "乙"), (1, "甲"), (2, "丙"), (2, "乙"), (2, "甲"), (5, "丁"), (5, "戊")]
    assert [r["k"] for r in terms.term_matches(texts, listed, "b", "t", "w", any_case=False).collect()] == []


def test_large_dictionaries_are_split(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK", 3)
    texts = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(0, 40, 2)))], "k long, b long, t string")
    listed = spark.createDataFrame([(1, f"w{i}") for i in range(40)], "b long, w string")
    assert sorted(r["w"] for r in terms.term_matches(texts, listed, "b", "t", "w").collect()) == sorted(f"w{i}" for i in range(0, 40, 2))


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "Keeper’s", "甲"), (1, "keeper's", "乙"), (1, "x", "甲"), (2, "keeper's", "甲"), (1, "x", None), (1, None, "q")], "b long, s string, t string")
    got = terms.conflicts(df, ["b"], "s", "t").collect()
    assert [(r["b"], r["term"], r["targets"]) for r in got] == [(1, "keeper's", sorted(["甲", "乙"]))]


def test_consolidate(spark):
    rows = [
        (1, "chunk-0002", "Kel’Dor", "凱多", "place", "high", "n1", 2), (1, "chunk-0001", "Kel'Dor", "凱多", None, "high", "n2", 1), (1, "chunk-0003", "Kel'Dor", " ", "place", None, "n1", 3),
        (1, "chunk-0001", " ", "x", None, None, None, 4), (1, "chunk-0004", "kel'dor", None, None, None, "n3", 5), (1, "chunk-0004", "kel'dor", None, None, None, "n4", 6),
    ]
    got = terms.consolidate(spark.createDataFrame(rows, SCAN), "book_id", ["at"]).collect()
    assert len(got) == 1
    row = got[0]
    assert row["mentions"] == 5 and row["first_chunk"] == "chunk-0001" and row["source_term"] == "Kel'Dor"
    assert [(e["value"], e["n"]) for e in row["candidate_targets"]] == [("凱多", 2)] and row["notes"] == ["n2", "n1", "n3"]


def test_new_terms_keep_the_first(spark):
    rows = [(1, "chunk-0001", "New", "a", None, None, None, 2), (1, "chunk-0001", "new", "b", None, None, None, 1), (1, "chunk-0001", "Known", "c", None, None, None, 1), (2, "c", "known", "d", None, None, None, 1)]
    known = spark.createDataFrame([(1, "KNOWN")], "book_id long, k string")
    got = terms.new_terms(spark.createDataFrame(rows, SCAN), known, "book_id", "source_term", "k", ["at"]).collect()
    assert sorted((r["book_id"], r["proposed_target"]) for r in got) == [(1, "b"), (2, "d")]


def test_targets_missing(spark):
    texts = spark.createDataFrame([(1, "Marlow came.", "他來了"), (1, "Marlow came.", "馬洛來了")], "b long, s string, t string")
    wanted = spark.createDataFrame([(1, "marlow", "馬洛"), (1, "", "x")], "b long, term string, w string")
    assert [r["t"] for r in terms.targets_missing(texts, wanted, "b", "s", "t", "term", "w").collect()] == ["他來了"]
