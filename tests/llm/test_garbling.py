import pytest

from inkloom.llm.garbling import cost, garbled_keys, repair, repair_encoding

PROSE = "“I won’t leave you here,” Vimï Stakril whispered. “Not before dawn…”\n\nHis naïveté amused the maître d’hôtel—Zoë paid 40 €."
SOUND = [
    PROSE, "The sign read CHÂTEAU ÔRSEL.", "She hummed “Ã minha nau”, a tune.", "A brass plate said ΑΡΓΩΝ and nothing else.", "¿Quién vive? cried the guard of Peña Olmá.",
    "The word Ètna was chalked beside a crossed-out Ñaro.", "Über allem lay the smell of crème brûlée.", "價格是 40 €。「你好，」他說。", "Привет, мир. Это текст.", "PART TWO · A Glass Table", "nobody in Ærøvik paid it", "",
]


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "mac_roman", "cp1251", "cp1250", "cp437"])
def test_utf8_read_as_legacy_is_restored(codec):
    bad = "".join(chr(b) if b >= 0x80 and not bytes([b]).decode(codec, "ignore") else bytes([b]).decode(codec) for b in PROSE.encode())
    assert bad != PROSE
    assert repair(bad) == (PROSE, 1, False)
    assert repair("Sound start. " + bad)[0] == "Sound start. " + PROSE


def test_nested_layers():
    bad = PROSE.encode().decode("latin-1").encode().decode("latin-1")
    assert repair(bad)[:2] == (PROSE, 2)


@pytest.mark.parametrize(("written", "read"), [("cp1252", "mac_roman"), ("mac_roman", "cp1252")])
def test_single_byte_mixups(written, read):
    text = "“I won’t leave you here,” Vimï Stakril whispered. “Not before dawn…”"
    assert repair(text.encode(written).decode(read))[:2] == (text, 1)


def test_sound_text_is_left_alone():
    for text in SOUND:
        assert repair(text) == (text, 0, False), text
        assert cost(text) < 2


def test_lost_characters_are_reported():
    assert repair("didn�t") == ("didn�t", 0, True)


def test_rows(spark):
    data = [(i, t) for i, t in enumerate(SOUND)] + [(50, None), (51, "didn�t"), (52, "Ã©tude"), (52, "Ã©tude"), (53, "x" * 500_000 + " won’t".encode().decode("cp1252"))]
    df = spark.createDataFrame([(*r, "a", True) for r in data], "key long, text string, restored string, garbled boolean")
    got = {r["key"]: r for r in repair_encoding(df, "key", "text").collect()}
    assert len(got) == len({k for k, _ in data})
    assert all(got[i]["restored"] == t and not got[i]["garbled"] for i, t in enumerate(SOUND)) and got[50]["restored"] is None
    assert got[52]["restored"] == "étude" and got[53]["restored"].endswith(" won’t")
    assert sorted(r["row_key"] for r in garbled_keys(df, "key", "text", "t").collect()) == [51, 52, 52, 53]
    assert garbled_keys(df.limit(0), "key", "text", "t").count() == 0
