import random

import pytest

from inkloom.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def samples():
    rng = random.Random(9)
    alphabet = "ab cde'stTHE \n\t é字😀.,!12²½_- 　​<|endoftext|>"
    return ["", " ", "\n\n  x", "it's we'll I'd", "<|endoftext|>", "字" * 500, "x" * 5000, "a" * 257, "👩‍🚀👍🏽 ok"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]


def test_ids_equal_the_public_tokenizer(spark, reference):
    texts = samples()
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(10_000, None, "q"), (3, texts[3], "q")], "doc_id long, text string, ids string")
    got = tokens.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert list(r["ids"]) == ([] if r["doc_id"] == 10_000 else reference(texts[r["doc_id"]]))
    counts = {r["doc_id"]: (r["tokens"], r["text"]) for r in tokens.encode(df, "doc_id", "text", count_only=True, carry=["text"]).collect()}
    assert all(n == (len(reference(t)) if t else 0) for n, t in counts.values())


def test_scan_and_heap_agree():
    ranks = tokens.read_ranks(tokens.default_vocabulary())
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeth \xe5\xad\x97\xf0\x9f") for _ in range(rng.randint(2, 250)))
        assert tokens.encode_word(word, ranks) == (tokens._encode_long(word, ranks) if word not in ranks else [ranks[word]])


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
