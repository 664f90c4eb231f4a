import pytest
from pyspark.sql import functions as F

from inkloom.operators import publish, quality


def codes(spark, text, simplified=""):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return {r["code"] for r in quality.issues(df, F.col("id"), quality.text_rules(F.col("t"), simplified)).collect()}


def test_text_rules(spark):
    bad = "# 一\n\n这是 a whole sentence that was left in English TODO 「未關閉。 *斜體"
    assert codes(spark, bad, "这门") == {"placeholder", "english_residue", "unbalanced_quotes_or_brackets", "unbalanced_emphasis", "simplified_chinese"}
    assert codes(spark, "# 一\n\n馬洛抵達了。「好。」*斜*\n\n* * *", "这门") == set()
    assert codes(spark, None) == set() and codes(spark, "") == set()


@pytest.mark.parametrize(("text", "error"), [("（「」）", None), ("「』", "unexpected 』"), ("((", "unclosed (("), ("“”", None), ("““”", "uneven “”"), (")", "unexpected )"), ("a[b{c}d]", None)])
def test_brackets(spark, text, error):
    assert spark.createDataFrame([(text,)], "t string").select(quality.bracket_error(F.col("t"))).first()[0] == error


def test_very_long_run_of_words(spark):
    assert spark.createDataFrame([("the and " * 20_000,)], "t string").select(F.size(quality.english_runs(F.col("t")))).first()[0] == 1


def test_paragraph_exception(spark):
    rows = [
        ("a\n\nb", "1\n\n2\n\n3", (None, 2, 3, None, "why"), False), ("a\n\nb", "1", (None, 2, 3, None, "why"), True), ("a", "1", None, False), ("a", "1\n\n2", None, True),
        ("a", "1\n\n2", (True, None, None, None, None), False), ("a", "1\n\n2", (None, None, 2, None, None), False), ("a", "1\n\n2", (None, None, 3, None, None), True),
        ("a", "1\n\n2", (None, None, None, 1, "why"), False), ("a", "1\n\n2", (None, 1, 2, None, None), True), ("a", "1\n\n2", (None, None, None, None, None), True),
    ]
    df = spark.createDataFrame(rows, f"s string, t string, e {quality.EXCEPTION}, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", quality.paragraph_mismatch(F.col("s"), F.col("t"), F.col("e"))).collect())


def test_simplified_only():
    own = quality.simplified_only()
    assert all(c in own for c in "这门们说国书") and not any(c in own for c in "這門說國書一人大")


def test_report_and_gate(spark):
    found = spark.createDataFrame([("a", "1", ""), ("a", "2", ""), ("b", "1", "")], quality.ISSUE)
    assert {r["code"]: r["n"] for r in quality.report([found]).collect()} == {"a": 2, "b": 1}
    assert quality.passed(found.limit(0)).first()["passed"]
    with pytest.raises(ValueError, match="a 1"):
        quality.assert_passed(found.orderBy("code", "key"))
    quality.assert_passed(found.limit(0))


def test_marker_mismatch(spark):
    chunks = spark.createDataFrame([(1, 1, "chunk-0001"), (1, 2, "chunk-0002"), (2, 1, "chunk-0001")], "b long, chunk_index int, chunk_id string")
    books = spark.createDataFrame([(1, "<!-- chunk-0002; source pages 1-1 -->\n<!-- chunk-0001; source pages 1-1 -->"), (2, "<!-- chunk-0001; source pages 1-1 -->")], "b long, t string")
    assert [r["b"] for r in quality.marker_mismatch(books, chunks, "b", "t").collect()] == [1]


def test_blocks_and_runs(spark):
    text = "<!-- chunk-0001; source pages 1-2 -->\n\n# 一\n\n潮水*漲了*。\n\n* * *"
    got = publish.blocks(spark.createDataFrame([(1, text)], "b long, t string"), "b", "t").orderBy("pos").collect()
    assert [(r["pos"], r["type"], r["content"]) for r in got] == [(1, "heading_1", "一"), (2, "paragraph", "潮水*漲了*。"), (3, "divider", "")]
    assert publish.inline_runs("潮水*漲了*。**b**") == [("潮水", False, False), ("漲了", False, True), ("。", False, False), ("b", True, False)]
    assert [len(r[0]) for r in publish.inline_runs("x" * 4500)] == [2000, 2000, 500] and publish.inline_runs("") == [("", False, False)]


def batches(spark, texts):
    books = spark.createDataFrame([(1, "\n\n".join(texts))], "b long, t string")
    return publish.batches(publish.blocks(books, "b", "t"), "b")


def test_publication_resumes_and_refuses(spark):
    rows = batches(spark, [f"p {i}" for i in range(205)])
    assert sorted((r["batch_no"], r["block_count"]) for r in rows.collect()) == [(1, 100), (2, 100), (3, 5)]
    store = publish.BlockStore()
    with pytest.raises(ConnectionError):
        publish.publish(rows, store, "b", fail_at=1)
    assert len(store.kept) == 1
    assert publish.publish(rows, store, "b") == 2 and publish.publish(rows, store, "b") == 0
    lossy = publish.BlockStore()
    lossy.write = lambda *args: publish.BlockStore.write(lossy, *args[:3], "garbled") if args[1] == 2 else publish.BlockStore.write(lossy, *args)
    with pytest.raises(ValueError, match="not kept"):
        publish.publish(rows, lossy, "b")
    store.kept[(1, 2)] = (100, "altered")
    with pytest.raises(ValueError, match="changed"):
        publish.publish(rows, store, "b")


def test_opening_blocks_and_canonical_form(spark):
    books = spark.createDataFrame([(1, "# 一\n\n<!-- chunk-0001; x -->\n\n# a\nb", "Tides", "N. Orr"), (2, None, "Empty", "")], "b long, t string, name string, author string")
    got = [(r["b"], r["pos"], r["type"], r["content"]) for r in publish.blocks(books, "b", "t", "name", "author").orderBy("b", "pos").collect()]
    first = [(1, "callout", "Traditional Chinese translation of Tides by N. Orr."), (2, "table_of_contents", ""), (3, "divider", "")]
    assert got == [(1, *x) for x in first] + [(1, 4, "heading_1", "一"), (1, 5, "paragraph", "# a\nb")] + [(2, 1, "callout", "Traditional Chinese translation of Empty by ."), *((2, *x) for x in first[1:])]
    flags = '"code":false,"content":"%s","italic":%s,"strikethrough":false,"underline":false'
    assert publish.canonical_block("paragraph", "é*x*") == '{"rich_text":[{"bold":false,' + flags % ("é", "false") + '},{"bold":false,' + flags % ("x", "true") + '}],"type":"paragraph"}'
    assert publish.canonical_block("divider", "") == '{"type":"divider"}'
    assert publish.canonical_block("callout", "a").startswith('{"icon":{"emoji":"📖","type":"emoji"},"rich_text":[')


def body(spark, n=205):
    books = spark.createDataFrame([(1, "\n\n".join(f"p {i}" for i in range(n)))], "b long, t string")
    return publish.marked(publish.blocks(books, "b", "t"), "b")


def test_batches_are_found_again(spark):
    whole = body(spark)
    found = {r["batch_no"]: r for r in publish.discover(whole, "b").collect()}
    assert {k: (r["state"], r["present"], r["marker_pos"]) for k, r in found.items()} == {1: ("verified", 100, 1), 2: ("verified", 100, 102), 3: ("verified", 5, 203)}
    changed = whole.withColumn("content", F.when(F.col("pos") == 150, "other").otherwise(F.col("content"))).filter("pos < 206")
    assert {r["batch_no"]: r["state"] for r in publish.discover(changed, "b").collect()} == {1: "verified", 2: "altered", 3: "incomplete"}
    odd = spark.createDataFrame([(1, 1, "paragraph", publish.BATCH_MARK + "1:x:1:h"), (1, 2, "paragraph", publish.BATCH_MARK + "1:2:0:h"), (1, 3, "paragraph", publish.BATCH_MARK + "1:2:0:h"), (1, 4, "paragraph", publish.BATCH_MARK + "9:2:0:h")], "b long, pos long, type string, content string")
    assert [r["state"] for r in publish.discover(odd, "b").orderBy("marker_pos").collect()] == ["malformed", "duplicate", "duplicate"]


def test_only_verified_blocks_may_be_removed(spark):
    whole = body(spark)
    by_hand = whole.withColumn("pos", F.col("pos") + 2).unionByName(spark.createDataFrame([(1, 1, "paragraph", "note"), (1, 300, "paragraph", "note")], "b long, pos long, type string, content string"))
    assert sorted(r["pos"] for r in publish.removable(by_hand, "b").collect()) == list(range(3, 211))
    orphan = whole.filter("pos <= 203")
    assert sorted(r["pos"] for r in publish.removable(orphan, "b").collect()) == list(range(1, 204))
    altered = whole.withColumn("content", F.when(F.col("pos") == 5, "x").otherwise(F.col("content")))
    assert publish.removable(altered, "b").count() == 0
