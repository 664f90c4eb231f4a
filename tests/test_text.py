import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from inkloom.functions import hashing, loose_json, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


def test_word_count_equals_the_plain_pattern(spark):
    samples = ["Don't ring Orr's bell!", "a-b -c d- --", "“Où?” l’été 2024_x", "", "'’-", "字 詞 abc123"]
    for s in samples:
        assert one(spark, text.word_count, s) == len(re.findall(r"\b[\w'’-]+\b", s))
    assert one(spark, text.word_count, None) is None


def test_normalize_page(spark):
    page = "Salt on the win-\ndow sills,\nsalt in the bread.\n\nThe bell rang."
    assert one(spark, text.normalize_page, page) == "Salt on the window sills, salt in the bread.\n\nThe bell rang."
    assert one(spark, text.normalize_page, "ﬁne  …\r\n\r\n \x00x") == "fine ...\n\nx"


def test_strip_and_paragraphs(spark):
    assert one(spark, text.strip, "　 a \n") == "a"
    assert one(spark, text.paragraphs, "\n\n a \n \n\nb\n\n") == ["a", "b"]


def test_join_wrapped(spark):
    assert one(spark, text.join_wrapped, ["har-", "bour wall", "north"], "array<string>") == "harbour wall north"


def test_slug_and_tail(spark):
    assert one(spark, text.slug, "Tides & Bells, II") == "tides-bells-ii"
    assert one(spark, text.slug, "***") == "book"
    assert one(spark, lambda c: text.tail(c, 2), "añb") == "ñb"


def test_casefold_is_that_of_unicode(spark):
    codes = [c for c in range(0x20, 0x2FFFF) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF]
    rows = spark.createDataFrame([(chr(c), chr(c).casefold()) for c in codes], "c string, f string")
    odd = rows.filter(text.casefold(F.col("c")) != F.col("f")).collect()
    # Cherokee folds to capitals, both its cases alike; other letters that differ are unknown to one side's Unicode version.
    others = [r["c"] for r in odd if not ("\u13a0" <= r["c"] <= "\u13fd" or "\uab70" <= r["c"] <= "\uabbf") and unicodedata.category(r["c"]) != "Cn"]
    assert not others, [hex(ord(c)) for c in others]
    assert one(spark, text.casefold, "STRASSE Straße ẞ ΟΔΟΣ ıI") == "strasse strasse ss οδοσ ıi"


def test_small_helpers(spark):
    assert one(spark, text.split_aliases, " a | |b|　c ") == ["a", "b", "c"]
    assert one(spark, text.file_name_of_task, "terms:12") == "terms--12"
    assert one(spark, lambda c: text.clean_line(c, {"teh": "the", "the cat": "a cat"}), " teh\0  \tcat ") == "a cat"
    assert one(spark, lambda c: hashing.hash_joined(c, F.lit("b")), "a") == hashlib.sha256(b"a\0b").hexdigest()
    assert hashing.hash_of({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    got = one(spark, lambda c: hashing.book_key(c, F.lit("2nd"), F.lit(None).cast("string"), F.lit("zh")), "978")
    assert got == "book-v1-" + hashlib.sha256(b'{"edition":"2nd","isbn":"978","locale":"zh","source_sha256":null}').hexdigest()[:32]
    df = spark.createDataFrame([('a "b"\n', None)], "x string, y string").select(hashing.json_line("y", "x").alias("l"))
    assert df.first()["l"] == '{"x": "a \\"b\\"\\n", "y": ""}'


def test_markers(spark):
    line = one(spark, lambda c: text.marker(c, F.lit(4), F.lit(9)), "chunk-0007")
    assert line == "<!-- chunk-0007; source pages 4-9 -->"
    found = one(spark, text.parse_markers, f"{line}\n\ntext\n{line}")
    assert [(m["chunk_id"], m["page_start"], m["page_end"]) for m in found] == [("chunk-0007", 4, 9)] * 2


def test_fixed_pieces(spark):
    assert [len(p) for p in one(spark, lambda c: text.fixed_pieces(c, 2000), "x" * 4500)] == [2000, 2000, 500]
    assert one(spark, lambda c: text.fixed_pieces(c, 2000), "") == [""]


def test_hashes(spark):
    assert one(spark, hashing.hash_text, "añ") == hashlib.sha256("añ".encode()).hexdigest()
    assert one(spark, hashing.hash_parts, "añ") == hashlib.sha256("añ\0".encode()).hexdigest()
    assert one(spark, hashing.canonical_json, '{"b": [1, {"y": null, "x": "é"}], "a": true}') == '{"a":true,"b":[1,{"x":"é","y":null}]}'
    assert one(spark, hashing.canonical_json, "{") is None


def test_loose_json(spark):
    good = lambda c: loose_json.parse_object(c).cast("string")
    assert one(spark, good, '```json\n{"terms": []}\n```') == '{"terms":[]}'
    assert one(spark, good, 'so: {"a": 1} done') == '{"a":1}'
    assert one(spark, good, "[1]") is None and one(spark, good, "nothing") is None
