import itertools
import unicodedata

from inkloom.llm.lookalikes import consistent, look_alike_pairs, look_alikes, skeleton

SAME = [
    ("王冠", "王⁠冠"), ("⿓⼭", "龍山"), ("Zoë", "Zoë"), ("ΡHОCEA 號", "PHOCEA 號"), ("Ｋ－９２ 型", "K-92 型"), ("甲‧乙", "甲・乙"), ("甲·乙", "甲∙乙"),
    ("谷 Ⅳ", "谷 ІV"), ("塔　Ⅻ", "塔 XII"), ("門（新４）", "門(新4)"), ("勞︀", "勞"), ("T‑3", "T−3"), ("a­b", "ab"), (" x ", "x"),
]
OTHER = [("SCION", "Scion"), ("Zoë", "Zoe"), ("甲‧乙", "甲-乙"), ("王冠", "王冠人"), ("甲 乙", "甲乙"), ("x²", "x2"), ("l1I", "lll"), ("O0", "00")]


def test_skeletons():
    for a, b in SAME:
        assert skeleton(a) == skeleton(b), (a, b)
        assert consistent(a) == consistent(b) and unicodedata.is_normalized("NFC", consistent(a))
    for a, b in OTHER:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton(None) is None and skeleton("​") == "" and skeleton("a" * 10**6) == "a" * 10**6


def rows(spark):
    texts = [t for pair in SAME + OTHER for t in pair] + [None, "", "​", "‌", "王冠"]
    return spark.createDataFrame([(i, i % 2, t, "x", "y") for i, t in enumerate(texts * 2)] + [(999, None, "王冠", "x", "y")], "k long, g long, t string, skeleton string, s string")


def test_pairs_equal_brute_force(spark):
    df = rows(spark)
    data = [(r["k"], r["g"], r["t"]) for r in df.collect()]
    want = {
        (a[0], b[0])
        for a, b in itertools.product(data, data)
        if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] and b[2] and a[2] != b[2] and skeleton(a[2]) and skeleton(a[2]) == skeleton(b[2])
    }
    got = [(r["first"], r["second"]) for r in look_alike_pairs(df, "k", "g", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_keep_every_row(spark):
    df = rows(spark)
    got = look_alikes(df, "k", "g", "t").collect()
    assert len(got) == df.count()
    assert all((r["class_id"] is None) == (not r["skeleton"] or r["g"] is None) for r in got)


def test_empty_table(spark):
    assert look_alike_pairs(rows(spark).limit(0), "k", "g", "t").count() == 0
