"""Text functions built from JVM expressions, with Arrow UDFs where Spark has none."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of word characters, apostrophes and hyphens that holds at
#: least one word character. Counts the same as ``\b[\w'’-]+\b``, without backtracking.
WORD = r"(?U)\w[\w'’-]*+"
# The blank line between blocks, Han characters, and the marker line of a chunk.
BLANK_LINE = r"(?U)\n\s*\n"
HAN = r"[㐀-鿿]"
MARKER = r"(?m)^<!--\s*(chunk-\d{4});\s*source pages\s+(\d+)-(\d+)\s*-->$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Words of a text; null for null."""
    return F.regexp_count(text, F.lit(WORD))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks and tabs as one blank."""
    return F.regexp_replace(text, r"[ \t]+", " ")


def unify_newlines(text: Column) -> Column:
    """NUL dropped; CR and CRLF as LF."""
    return F.regexp_replace(F.translate(text, "\0", ""), r"\r\n?", "\n")


def join_hyphenated(text: Column) -> Column:
    """A hyphen between word characters at a line end goes, with the line end."""
    return F.regexp_replace(text, r"(?U)(?<=\w)-\n(?=\w)", "")


def paragraphs(text: Column) -> Column:
    """Blank-line separated blocks, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(text, BLANK_LINE, -1), strip), lambda p: p != "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; plain ASCII passes as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def casefold(text: Column) -> Column:
    """Full Unicode case folding with built-in functions: upper case, then lower case.

    The letters that this would change otherwise are set apart: capital sharp s,
    final sigma, and the dotless i, which has no upper case of its own.
    """
    # The replacement stands between the two, or the optimizer would leave the first of them out.
    capital = F.replace(F.upper(F.translate(text, "ı", "\ue000")), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(capital), "ς\ue000", "σı")


def normalize_page(text: Column) -> Column:
    """A page in NFKC as blocks of one line each, parted by a blank line."""
    text = join_hyphenated(unify_newlines(nfkc(text)))
    blocks = F.transform(
        F.split(text, BLANK_LINE, -1),
        lambda b: F.array_join(F.filter(F.transform(F.split(collapse_blanks(b), "\n", -1), strip), lambda x: x != ""), " "),
    )
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def clean_line(text: Column, repairs: dict[str, str]) -> Column:
    """One extracted line: NFKC, no NUL, single blanks, literal repairs applied in order."""
    out = strip(collapse_blanks(F.translate(nfkc(text), "\0", "")))
    for wrong, right in repairs.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def join_wrapped(lines: Column) -> Column:
    """Wrapped lines as one paragraph: a broken word is rejoined, other lines get a blank between."""
    return F.aggregate(
        lines,
        F.lit(""),
        lambda done, line: F.when(done == "", line)
        .when(done.rlike(r"(?U)\w-$") & line.rlike(r"(?U)^\w"), F.concat(F.regexp_replace(done, "-$", ""), line))
        .otherwise(F.concat_ws(" ", done, line)),
    )


def slug(text: Column, default: str = "book") -> Column:
    """Lower-case ASCII letters and digits joined by hyphens."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(casefold(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit(default))


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def han_ratio(text: Column, words: Column) -> Column:
    """Han characters per source word, to three places."""
    return F.bround(han_count(text) / F.greatest(F.lit(1), words), 3)


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def fold_term(term: Column) -> Column:
    """Key of a term: typographic apostrophes made plain, case folded."""
    return casefold(F.replace(term, F.lit("’"), F.lit("'")))


def split_aliases(aliases: Column) -> Column:
    """Values between bars, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(aliases, r"\|", -1), strip), lambda a: a != "")


def marker(chunk_id: Column, first: Column, last: Column) -> Column:
    """The comment line that opens a chunk in an assembled book."""
    return F.format_string("<!-- %s; source pages %d-%d -->", chunk_id, first, last)


def parse_markers(text: Column) -> Column:
    """All marker lines as an array of (chunk_id, first, last)."""
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)).alias("a"),
            F.regexp_extract_all(text, F.lit(MARKER), F.lit(2)).alias("b"),
            F.regexp_extract_all(text, F.lit(MARKER), F.lit(3)).alias("c"),
        ),
        lambda m: F.struct(m["a"].alias("chunk_id"), m["b"].cast("int").alias("page_start"), m["c"].cast("int").alias("page_end")),
    )


def file_name_of_task(task_id: Column) -> Column:
    return F.replace(task_id, F.lit(":"), F.lit("--"))


def fixed_pieces(text: Column, width: int) -> Column:
    """A text cut into pieces of ``width`` characters; an empty text gives one empty piece."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))
