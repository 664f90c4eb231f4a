import pytest

from inkloom.operators.packed import split_packed, split_rule

CASES = [
    ("Ann; Bob ;; Cy;", ["Ann", "Bob", "Cy"]),
    ("'Nine/Ten'/ Keys", ["Nine/Ten", "Keys"]),
    ('"Bist ""Bisie"" Redon"；Bist', ['Bist "Bisie" Redon', "Bist"]),
    ('Lamom "Lamix" Kulod、Lamom', ['Lamom "Lamix" Kulod', "Lamom"]),
    ("D'Krotrask\tthe King's Liar\nOne", ["D'Krotrask", "the King's Liar", "One"]),
    ('["Gwami \\"Gwy\\" Black", "A, B", ""]', ['Gwami "Gwy" Black', "A, B"]),
    ("「Keys; Locks」 | “Hy”", ["Keys; Locks", "Hy"]),
    ("[not json; at all", ["[not json", "at all"]),
    ("\"open; never closed", ['"open', "never closed"]),
    ("single", ["single"]),
    ("x" * 100_000 + ";y", ["x" * 100_000, "y"]),
]


def test_values_and_positions(spark):
    rows = [(i, t, "clash", "clash") for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, packed string, value string, skeleton string")
    got = {}
    for r in split_packed(df, "id", "packed").orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["value"]))
    for i, (_, want) in enumerate(CASES):
        assert got[i] == list(enumerate(want, 1))


def test_null_blank_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "a|b"), (4, "a|b"), (None, "q")], "id long, packed string")
    got = sorted((r["id"] or 0, r["pos"], r["value"]) for r in split_packed(df, "id", "packed").collect())
    assert got == [(0, 1, "q"), (4, 1, "a"), (4, 1, "a"), (4, 2, "b"), (4, 2, "b")]
    assert split_packed(df.limit(0), "id", "packed").count() == 0


def test_same_rows_when_rules_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, packed string")
    assert sorted(split_packed(df, "id", "packed", broadcast_rows=1).collect()) == sorted(split_packed(df, "id", "packed").collect())


@pytest.mark.parametrize("skeleton", ["", " ", ";;", '""', "[]", '[""]'])
def test_rules_without_values(skeleton):
    assert split_rule(skeleton) == []
