"""Visually identical text with different characters.

Confusables skeleton: decompose, replace every character by its prototype from
a look-alike table, decompose again.  Texts of equal skeleton look the same.

The table covers letters that look like Latin ones (Greek, Cyrillic, Armenian,
Cherokee and phonetic letters), dots, hyphens and blanks; forms of width, font
and size come from the character database.  Letters of other scripts that look
like one another, digits that look like letters (O and 0, l and 1), and
simplified and traditional forms are kept apart.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.session import cut_lineage

# Letters of other scripts that look like a Latin letter, as
# "prototype: look-alikes". Letter case is kept apart.
LETTERS = """
A: Α А Ꭺ   B: Β В Ᏼ   C: С Ϲ Ꮯ   D: Ꭰ   E: Ε Е Ꭼ   F: Ϝ   G: Ԍ Ꮐ   H: Η Н Ꮋ
I: Ι І Ӏ   J: Ј Ꭻ   K: Κ К Ꮶ   L: Ꮮ   M: Μ М Ꮇ   N: Ν   O: Ο О Օ   P: Ρ Р Ꮲ
Q: Ԛ   S: Ѕ Տ Ꮪ   T: Τ Т Ꭲ   U: Ս   V: Ѵ Ꮩ   W: Ԝ Ꮃ   X: Χ Х   Y: Υ Ү Ꮍ   Z: Ζ Ꮓ
a: а ɑ α   c: с ϲ   d: ԁ   e: е   g: ց ɡ   h: һ հ   i: і ι ı   j: ј ϳ   k: κ   l: ӏ
n: ո   o: о ο օ   p: р ρ   q: ԛ   s: ѕ   u: υ ս   v: ν ѵ   w: ԝ   x: х χ   y: у γ   z: ᴢ
"""
DOTS = "·•‧∙⋅・･᛫⸳\u0387"
HYPHENS = "-‐‑‒–−－﹣⁃˗"
#: Decompositions that change nothing a reader sees but width or shape.
PLAIN_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>")
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


class _Prototypes(dict):
    """Character code to its prototype, worked out when first asked for."""

    def __init__(self) -> None:
        super().__init__()
        words = LETTERS.split()
        prototype = ""
        for word in words:
            if word.endswith(":"):
                prototype = word[:-1]
            else:
                self[ord(word)] = prototype
        self.update({ord(c): "·" for c in DOTS})
        self.update({ord(c): "-" for c in HYPHENS})

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind[0] == "Z" or char in "\t\n\r\x0b\x0c\x85":
            out = " "
        elif kind in ("Cf", "Cc") or char in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        else:
            tag, _, rest = unicodedata.decomposition(char).partition(" ")
            if tag.startswith("<") and tag in PLAIN_TAGS:
                out = "".join(self[ord(c)] for x in rest.split() for c in unicodedata.normalize("NFD", chr(int(x, 16))))
            else:
                out = char
        self[code] = out
        return out


PROTOTYPES = _Prototypes()


def skeleton(text: str | None) -> str | None:
    """What a reader sees of a text; equal for texts that look the same.

    Width and blanks are levelled, characters that show nothing go, blanks at
    the ends go too. Letter case, accents and other visible marks stay.
    """
    if text is None:
        return None
    seen = unicodedata.normalize("NFD", text).translate(PROTOTYPES)
    return " ".join(unicodedata.normalize("NFD", seen).split())


def consistent(text: str | None) -> str | None:
    """The one form in which equal-looking texts are stored: the composed skeleton."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text))


FORMS = T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("consistent", T.StringType())])


@F.pandas_udf(FORMS)
def forms_udf(text: pd.Series) -> pd.DataFrame:
    seen = text.map(skeleton)
    return pd.DataFrame({"skeleton": seen, "consistent": seen.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))})


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the columns ``skeleton`` and ``consistent`` of a text, both from one visit to Python; null for null, empty for what shows nothing."""
    return df.withColumn("_forms", forms_udf(F.col(text))).withColumns({"skeleton": F.col("_forms.skeleton"), "consistent": F.col("_forms.consistent")}).drop("_forms")


def look_alikes(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """One row per row of ``df``: its consistent form and its class.

    Columns: ``key``, ``group``, ``text``, ``skeleton``, ``consistent``,
    ``class_id`` (smallest key of the equal-looking rows of a group) and
    ``forms`` (how many different strings the class has).  Null and empty texts
    keep their row with a null class.  Forms are worked out once and written.
    """
    rows = cut_lineage(with_forms(df.select(key, group, text), text))
    shown = F.length("skeleton") > 0
    classes = rows.filter(shown).groupBy(group, "skeleton").agg(F.min(key).alias("class_id"), F.count_distinct(text).alias("forms"))
    return rows.join(classes, [group, "skeleton"], "left").select(key, group, text, "skeleton", "consistent", "class_id", "forms")


def look_alike_pairs(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """Pairs of keys (``first``, ``second``) whose texts look the same and are not the same string.

    Both are of one group; rows with a null group, or a null or empty text, are
    in no pair, nor are texts that show nothing at all.  Skeletons are worked out
    once and written.  Classes with a single spelling are left out by a map-side
    aggregate before anything is joined, and the pairs of a class come from an
    equi-join on (group, skeleton), which AQE can split where one class is large.
    """
    rows = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(text).alias("t")).filter(F.col("g").isNotNull() & (F.length("t") > 0))
    rows = cut_lineage(with_forms(rows, "t").select("k", "g", "t", F.col("skeleton").alias("s")).filter(F.length("s") > 0))
    mixed = rows.groupBy("g", "s").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("g", "s")
    several = rows.join(mixed, ["g", "s"], "left_semi")
    a, b = several.alias("a"), several.alias("b")
    return (
        a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.t") != F.col("b.t")))
        .select(F.col("a.k").alias("first"), F.col("b.k").alias("second"))
    )
