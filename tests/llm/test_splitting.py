import random
import re

from pyspark.sql import functions as F

from inkloom.llm.splitting import cut_text, oversized, split_oversized

ARGS = ("key", "text")
LIMITS = ("book", "target", "most", "overlap")


def words(s):
    return len(re.findall(r"\b[\w'’-]+\b", s))


def test_pieces_cover_the_text_within_the_limit():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a-b ", "end. ", "What? ", "pause, ", "\n", "\n\n", "Chapter 2\n\n", "—", "字。"]) for _ in range(rng.randint(0, 400)))
        most = rng.randint(1, 40)
        overlap = rng.randint(0, 12)
        pieces = cut_text(text, rng.randint(1, most), most, overlap)
        assert "".join(text[s:e] for _, s, e in pieces) == text
        if words(text) > most:
            for i, (back, start, end) in enumerate(pieces):
                assert words(text[back:end]) <= most
                assert back == start if i == 0 else back <= start
                assert words(text[back:start]) <= overlap


def test_paragraphs_are_cut_before_sentences():
    text = "\n\n".join(" ".join(["w"] * 9) + ". " + " ".join(["v"] * 9) + "." for _ in range(6))
    assert all(text[s - 2 : s] == "\n\n" for _, s, _ in cut_text(text, 40, 60, 0)[1:])


def test_query_form(spark):
    long = " ".join(["w"] * 50)
    data = [(1, 1, "short one"), (2, 1, long), (2, 1, long), (3, 1, None), (4, 1, ""), (5, 9, long), (6, None, long), (7, 1, "w" * 300_000), (8, 2, "one two")]
    df = spark.createDataFrame([(*r, 0, "q") for r in data], "key long, book long, text string, words int, piece_no string")
    limits = spark.createDataFrame([(1, 8, 10, 2), (2, 0, 0, 5)], "book long, target int, most int, overlap int")
    got = split_oversized(df, *ARGS, limits, *LIMITS).collect()
    assert {r["key"] for r in got} == set(range(1, 9))
    assert all(r["words"] <= 10 for r in got if r["key"] == 2) and all(r["n_pieces"] == 1 for r in got if r["key"] in (1, 3, 4, 5, 6, 7))
    assert [r["text"] for r in got if r["key"] == 3] == [None] and [r["text"] for r in got if r["key"] == 4] == [""]
    assert sorted(r["key"] for r in oversized(df, *ARGS, limits, *LIMITS).collect()) == [2, 2, 8]
    assert oversized(df.filter(F.lit(False)), *ARGS, limits, *LIMITS).count() == 0
