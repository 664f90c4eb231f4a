import itertools
import random

from inkloom.llm.truncation import longer_copies, truncation_evidence, truncation_rates

SCHEMA = "doc_id long, text string, source string, truncated boolean"
SENTENCES = ["The river was silent before dawn.", "Who carried the lantern?", "“We are,” said the guard.", "It took twelve days to reach the harbor."]


def test_prefixes_equal_brute_force(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"字", "字句", "x" * 200_000, "x" * 200_001}
    rows = [(i, t, "s", True) for i, t in enumerate([*texts, *texts, None, ""])]
    df = spark.createDataFrame(rows, SCHEMA)
    from inkloom.llm.truncation import _text_hashes
    from pyspark.sql import functions as F

    hashes = {(r["h1"], r["h2"]): r["text"] for r in df.select("text", *_text_hashes(F.col("text"))).distinct().collect()}
    for partitions in (1, 3, 16):
        got = [hashes[r["h1"], r["h2"]] for r in longer_copies(df, "text", partitions).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {a for a, b in itertools.product(texts, texts) if len(a) < len(b) and b.startswith(a)}


def documents(spark):
    rng = random.Random(6)
    rows, cut = [], set()

    def add(text, source, is_cut):
        if is_cut:
            cut.add(len(rows))
        rows.append((len(rows), text, source, False))

    story = lambda n: " ".join(rng.choice(SENTENCES) for _ in range(n))
    for _ in range(60):
        add(story(rng.randint(8, 30)), "prose", False)
    whole = story(40)
    add(whole, "prose", False)
    add(whole[:155], "prose", True)
    add(story(9) + "\n\nThe wagon cros", "prose", True)
    add(story(9) + "\n\nYours,\nAnn Bow", "prose", False)
    add(story(9) + "\n\n* * *", "prose", False)
    add(story(9) + "\n[applause]", "prose", False)
    add(story(9) + " The wag�", "prose", True)
    add(story(9) + " The gate was clo [...]", "prose", True)
    for i in range(60):
        add(f"loved the part where {'ab' * (i + 1)} won", "posts", False)
    for i in range(12):
        add((f"post {i} " + story(12))[:199] + "x", "posts", True)
    for t in (None, "", "  \n", "\t"):
        add(t, "prose", False)
    add(whole[:155], None, True)
    return spark.createDataFrame(rows, SCHEMA), cut


def test_verdicts(spark):
    df, cut = documents(spark)
    evidence = truncation_evidence(df, "doc_id", "text", "source")
    got = evidence.collect()
    assert len(got) == df.count()
    assert {r["doc_id"] for r in got if r["truncated"]} == cut
    rates = {r["source"]: (r["texts"], r["truncated_texts"]) for r in truncation_rates(evidence, "source").collect()}
    assert rates["posts"] == (72, 12) and rates[None] == (1, 1)


def test_closing_lines_do_not_depend_on_the_number_of_texts(spark):
    rng = random.Random(9)
    rows, cut = [], set()
    story = lambda n: " ".join(rng.choice(SENTENCES) for _ in range(n))
    for i in range(60):
        rows.append((len(rows), f"Part {i}. {story(8)}\n\nThe river was silent before dawn. {story(3)}", "prose", False))
    for i in range(5):
        rows.append((len(rows), f"Part {i}. {story(9)}\n\nTHE END", "prose", False))
        cut.add(len(rows))  # a stub that five texts share, as it happens in any large table
        rows.append((len(rows), f"Part {i}. {story(9)}\n\nThe riv", "prose", False))
    for i in range(11):
        cut.add(len(rows))
        rows.append((len(rows), (f"post {i} " + story(12))[:199] + "x", "posts", False))
    cut.add(len(rows))
    rows.append((len(rows), (story(12)[:180] + "\n- a bullet cut at its limit")[:200], "posts", False))
    cut.add(len(rows))
    rows.append((len(rows), "Things to bring\n- a lant", "lists", False))
    rows.append((len(rows), "Things to bring\n- a lantern", "lists", False))
    evidence = truncation_evidence(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").collect()
    assert {r["doc_id"] for r in evidence if r["truncated"]} == cut


def test_marks_of_omission_are_no_natural_ellipses(spark):
    rows = [(i, f"{i} bells rang. It was th… read more", "feed", True) for i in range(8)]
    rows += [(10 + i, f"{i} men closed the door… then waited. " + "One more door. " * 30, "notes", False) for i in range(6)]
    rows += [(20 + i, f"{i} men went to the arches… Nobody came. {i} men sat below the arches.", "notes", False) for i in range(3)]
    rows += [(30, "Two men stood by the arches…", "feed", False), (31, "Nobody came, and th…", "feed", True), (32, "Nobody came to the door…", "feed", True)]
    evidence = truncation_evidence(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").collect()
    assert {r["doc_id"] for r in evidence if r["omission"]} == {r[0] for r in rows if r[3]}


def test_empty_table(spark):
    df, _ = documents(spark)
    assert truncation_evidence(df.limit(0), "doc_id", "text", "source").count() == 0
