import random

import numpy as np

from inkloom.llm.boosting import Boosted
from inkloom.llm.scans import _KINDS, _TOKEN, _furniture_of, _labels, _Lines, confusion_cost, fault_kinds, fit_furniture, repair_scans, scan_skeleton

WORDS = "the granary lantern window morning another counted silence behind harbor bridge marble winter scholar followed between memory carried shadow kitchen river ferryman orchard patient".split()
SCHEMA = "table_name string, key long, book long, text string, book_name string, author string, kind string, wrong string"
NAMES = ("A Glass Table for Gwubost", "Craedrév Pilmcend")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def texts(spark, extra):
    rng = random.Random(4)
    rows = [("pages", i, i % 6, prose(rng, 60), *NAMES) for i in range(120)] + [("chunks", k, 1, t, *NAMES) for k, t in extra]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    assert ((Boosted().fit(x[:600], y[:600]).score(x[600:]) > 0.5) == y[600:]).mean() > 0.95
    assert Boosted().fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))).shape == (2,)


def test_skeletons_and_costs():
    assert scan_skeleton("A GLASS TABLF 0F") == scan_skeleton("a glass table of") or scan_skeleton("0F") == scan_skeleton("of")
    assert scan_skeleton("M I R R O R") == scan_skeleton("mirror")
    assert confusion_cost("rnoming", "morning")[2] >= 0 and confusion_cost("bebind", "behind")[1:] == (1, 0)
    assert confusion_cost("riever", "never")[1:] == (1, 0) and confusion_cost("lantern", "lanterns")[2] == 1


MODELS = fit_furniture([], list(NAMES))


def furniture(text):
    return _furniture_of([(text, list(NAMES))], MODELS)[0]


def test_furniture():
    for line in ("A GLASS TABLE FOR GWUBOST", "CRAEDRÉV PILMCEND    12", "13  PART TWO · A Glass Table for Gwubost", "A G L A S S   T A B L E   F O R   G W U B O S T"):
        header, number, clean = furniture(f"first line\n{line}\nlast line")
        assert header and clean == "first line\nlast line" and number == any(c.isdigit() for c in line), line
    for line in ("12", "* xii *", "- 9 -", "Page l7", "[4]", "p. 30", "· 2O ·", "iv"):
        assert furniture(f"a b c d\n{line}\nb") == (False, True, "a b c d\nb"), line
    for line in ("Chapter 2", "THREE", "It took 12 days", "23.", "mix", "A BRASS PLATE"):
        assert furniture(f"a b c d\n{line}\nb")[:2] == (False, False), line
    assert furniture("") == (False, False, "") and furniture("x" * 50_000)[:2] == (False, False)


def test_classifiers_agree_with_held_out_labels():
    rng = random.Random(11)
    names = [f"{a} {b} of {c}" for a in ("Silent", "Copper", "Northern", "Second") for b in ("Harbors", "Windows", "Orchards") for c in ("Velmora", "Tidewater", "Ashgrove")]
    rng.shuffle(names)
    lines, held = [], []
    for k, name in enumerate(names):
        for line in (name.upper(), f"{name.upper()}   {k + 2}", f"{k + 2}  {name}", f"- {k} -", str(k), "FOUR", f"Chapter {k}", prose(rng, 9), prose(rng, 5).upper(), f"{prose(rng, 6)} {name} {prose(rng, 6)}"):
            (held if k % 3 == 0 else lines).extend(x for _, x in _Lines(f"{prose(rng, 8)}\n{line}\n{prose(rng, 8)}", [name, "Orla Venn"]).found)
    models = fit_furniture(lines, [])
    want = np.array([_labels(x) for x in held])
    got = np.column_stack([models[k].score(np.array(held)) >= 0.5 for k in _KINDS])
    assert (want == got).mean() > 0.97


def test_kinds_and_repair(spark):
    rng = random.Random(8)
    extra = [
        (500, prose(rng, 20) + " the lanterri " + prose(rng, 5)), (501, "the granary sha-\ndow " + prose(rng, 20)), (502, prose(rng, 8) + "\nA GLASS TABLE FOR GWUBOST\n" + prose(rng, 8)),
        (503, prose(rng, 8) + "\n14\n"), (504, None), (505, ""), (506, "the w1nter bri- dge " + prose(rng, 9)), (507, prose(rng, 30)),
    ]
    df = texts(spark, extra)
    got = {}
    for r in fault_kinds(df).collect():
        got.setdefault(r["row_key"], set()).add(r["kind"])
    assert got == {500: {"misread"}, 501: {"hyphen"}, 502: {"header"}, 503: {"page_number"}, 506: {"misread", "hyphen"}}
    fixed = {r["key"]: r["repaired"] for r in repair_scans(df).filter("table_name = 'chunks'").collect()}
    assert "lanterri" not in fixed[500] and "the lantern " in fixed[500] and fixed[501].startswith("the granary shadow ")
    assert "GLASS" not in fixed[502] and "\n" not in fixed[502] and "14" not in fixed[503] and fixed[504] is None and fixed[505] == ""
    assert fixed[506].startswith("the winter bridge ") and fixed[507] == extra[7][1]


def test_marks_at_the_ends_of_words(spark):
    assert _TOKEN.findall("!nside “!vory” |antern wel| 'signa|.' |vory") == ["!nside", "!vory", "|antern", "wel|", "signa|", "|vory"]
    assert _TOKEN.findall("Stop!now ended! a | b |3 ! x!") == ["Stop!now", "ended", "a", "b", "3", "x"]
    rng = random.Random(5)
    words = [(600 + i, "the silence " + " inside a signal ".join([prose(rng, 3)] * 3)) for i in range(60)]
    extra = [(500, prose(rng, 20) + " !nside the harbor"), (501, prose(rng, 9) + " the signa|, " + prose(rng, 9)), (502, prose(rng, 9) + " the |antern.")]
    df = texts(spark, words + extra)
    assert {(r["row_key"], r["kind"]) for r in fault_kinds(df).collect()} == {(k, "misread") for k, _ in extra}
    fixed = {r["key"]: r["repaired"] for r in repair_scans(df).filter("table_name = 'chunks'").collect()}
    assert fixed[500].endswith(" inside the harbor") and " the signal, " in fixed[501] and fixed[502].endswith(" the lantern.")


def test_repeated_misreadings_of_names(spark):
    rng = random.Random(6)
    named = [(600 + i, f"{prose(rng, 9)} Greywood saw Harborton and Talbot by the {prose(rng, 9)}") for i in range(60)]
    wrong = [(700 + i, f"{prose(rng, 9)} Greyvvood left the {prose(rng, 9)}") for i in range(8)] + [(720 + i, f"{prose(rng, 9)} Harb0rton left the {prose(rng, 9)}") for i in range(8)]
    others = [(740 + i, f"{prose(rng, 9)} Silvester left the {prose(rng, 9)}") for i in range(8)]
    df = texts(spark, named + wrong + others)
    assert {(r["row_key"], r["kind"]) for r in fault_kinds(df).collect()} == {(k, "misread") for k, _ in wrong}


def test_empty_table(spark):
    assert fault_kinds(texts(spark, []).limit(0)).count() == 0
