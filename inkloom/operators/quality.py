"""Rule checks over texts and their records; every rule gives rows of one issue schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import MARKER, let, paragraphs

# Patterns of unfinished or untranslated text, common English words, pairs of marks.
PLACEHOLDER = r"(?i)(?:\b(?:TODO|TBD|FIXME|LOREM\s+IPSUM|TRANSLATION)\b|\?\?\?|\[\[.+?\]\]|\{\{.+?\}\}|<placeholder>)"
LATIN_RUN = r"[A-Za-z][A-Za-z'’-]*+(?:[ \t]++[A-Za-z][A-Za-z'’-]*+){4,}+"
COMMON_ENGLISH = "a an and are as at be been but by for from had has have he her him his i in is it its not of on or she that the their them they this to was were will with you your".split()
BRACKETS = {"「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "［": "］", "｛": "｝", "(": ")", "[": "]", "{": "}"}
NUMBER_WORD = (
    r"(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|"
    r"Twenty|Thirty|Forty|Fifty|Sixty|Seventy|Eighty|Ninety)(?:[- ](?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine))?"
)
SOURCE_HEADING = rf"(?i)^(?:Prologue|Epilogue|Introduction|Afterword|{NUMBER_WORD}|(?:Chapter|Part|Book)\s+(?:\d+|[IVXLCDM]+|{NUMBER_WORD}))$"
TARGET_HEADING = r"^#{1,6}\s+\S.*$"
DIVIDER_LINE, COMMENT = r"(?m)^\s*\*\s+\*\s+\*\s*$", r"(?s)<!--.*?-->"
BOLD_MARK, ITALIC_MARK = r"(?<!\\)\*\*", r"(?<!\\)\*"

ISSUE = "code string, key string, details string"


def simplified_only() -> str:
    """Han characters of the simplified standard set that the traditional one lacks, worked out from the two encodings."""

    def has(c: str, encoding: str) -> bool:
        try:
            return bool(c.encode(encoding))
        except UnicodeEncodeError:
            return False

    return "".join(c for c in map(chr, range(0x4E00, 0x9FA6)) if has(c, "gb2312") and not has(c, "big5"))


def placeholders(text: Column) -> Column:
    """Distinct unfinished marks in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def english_runs(text: Column) -> Column:
    """All runs of five or more Latin words of which at least two are common English ones."""
    common = rf"(?<![a-z])(?:{'|'.join(COMMON_ENGLISH)})(?![a-z])"
    return F.filter(F.regexp_extract_all(text, F.lit(LATIN_RUN), F.lit(0)), lambda r: F.regexp_count(F.lower(r), F.lit(common)) >= 2)


def foreign_characters(text: Column, characters: str, allowed: str = "") -> Column:
    """Characters of a text that are of a given set, such as the simplified forms of a script, sorted."""
    own = "".join(dict.fromkeys(c for c in characters if c not in allowed))
    if not own:
        return F.array().cast("array<string>")
    # A set of thousands makes a slow pattern; translating looks each distinct character up in a table.
    return F.array_sort(F.filter(F.array_distinct(F.split(text, "")), lambda c: (c != "") & (F.translate(c, own, "") == "")))


def bracket_error(text: Column) -> Column:
    """What is wrong with the brackets and quotation marks of a text; null if nothing."""
    bare = F.regexp_replace(text, r"[^「」『』（）【】《》〈〉〔〕［］｛｝()\[\]{}]+", "")
    # A mark and its partner side by side change nothing; with them gone, and again, next to nothing is left to fold.
    for _ in range(4):
        bare = F.regexp_replace(bare, "|".join(f"\\{a}\\{b}" if a in "([{" else a + b for a, b in BRACKETS.items()), "")
    marks = F.filter(F.split(bare, ""), lambda c: c != "")
    opens = F.create_map(*(x for a, b in BRACKETS.items() for x in (F.lit(b), F.lit(a))))

    def push(stack: Column, c: Column) -> Column:
        opener = F.try_element_at(opens, c)
        return (
            F.when(stack.startswith("!"), stack)
            .when(opener.isNull(), F.concat(stack, c))
            .when(F.right(stack, F.lit(1)) == opener, F.substring(stack, F.lit(1), F.length(stack) - 1))
            .otherwise(F.concat(F.lit("!"), c))
        )

    uneven = [F.when(F.regexp_count(text, F.lit(a)) != F.regexp_count(text, F.lit(b)), F.lit(f"uneven {a}{b}")) for a, b in ("“”", "‘’")]
    said = lambda left: F.when(left.startswith("!"), F.concat(F.lit("unexpected "), F.substring(left, 2, 1))).when(left != "", F.concat(F.lit("unclosed "), F.right(left, F.lit(10))))
    return F.coalesce(let(F.aggregate(marks, F.lit(""), push), said), *uneven)


def emphasis_error(text: Column) -> Column:
    """Odd numbers of bold or italic marks; null if even."""
    clean = F.regexp_replace(F.regexp_replace(text, DIVIDER_LINE, ""), COMMENT, "")
    bold = F.regexp_count(clean, F.lit(BOLD_MARK))
    italic = F.regexp_count(F.regexp_replace(clean, BOLD_MARK, ""), F.lit(ITALIC_MARK))
    return F.when(bold % 2 == 1, F.lit("odd bold marks")).when(italic % 2 == 1, F.lit("odd italic marks"))


def headings(text: Column, pattern: str) -> Column:
    return F.filter(paragraphs(text), lambda p: p.rlike(pattern))


EXCEPTION = "struct<any:boolean,source:int,target:int,delta:int,reason:string>"


def paragraph_mismatch(source: Column, target: Column, exception: Column | None = None) -> Column:
    """Whether the paragraph counts differ and no exception excuses it.

    An exception (``EXCEPTION``) holds if it is for any counts, or if it names a
    target count without more, or if it gives a reason and every count it names is
    the one found.
    """
    return counts_mismatch(F.size(paragraphs(source)), F.size(paragraphs(target)), exception)


def counts_mismatch(s: Column, t: Column, exception: Column | None = None) -> Column:
    """The same for paragraphs that are counted already."""
    if exception is None:
        return s != t
    named = lambda field, found: F.coalesce(exception[field] == found, F.lit(True))
    fits = named("source", s) & named("target", t) & named("delta", t - s)
    reasoned = F.coalesce(F.length(exception["reason"]) > 0, F.lit(False))
    only_target = exception["target"].isNotNull() & exception["source"].isNull() & exception["delta"].isNull() & exception["reason"].isNull()
    excused = exception.isNotNull() & (F.coalesce(exception["any"], F.lit(False)) | (fits & (reasoned | only_target)))
    return (s != t) & ~F.coalesce(excused, F.lit(False))


def issues(df: DataFrame, key: Column, rules: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """Issues of all rules in one pass: for each code a condition and its details.

    Without a condition, details that are not null are the issue, and are worked
    out once.  One scan of ``df`` serves all rules; rows without an issue give none.
    """

    def issue(code: str, details: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), key.cast("string").alias("key"), details.cast("string").alias("details"))

    def rule(code: str, when: Column | None, details: Column) -> Column:
        if when is None:
            return let(details, lambda d: F.when(d.isNotNull(), issue(code, d)))
        return F.when(F.coalesce(when, F.lit(False)), issue(code, details))

    each = [rule(code, when, details) for code, (when, details) in rules.items()]
    return df.select(F.explode(F.filter(F.array(*each), lambda i: i.isNotNull())).alias("i")).select("i.*")


def text_rules(text: Column, simplified: str = "", allowed: dict[str, list[str]] | None = None) -> dict[str, tuple[None, Column]]:
    """The rules on a single text.

    ``allowed`` excuses what it lists under ``simplified``, ``placeholder`` and
    ``english``.  Details show at most ten runs of English, as a report does; the
    rule itself looks at all of them.
    """
    allowed = allowed or {}

    def less(found: Column, kind: str) -> Column:
        listed = allowed.get(kind)
        return F.array_except(found, F.array(*map(F.lit, listed))) if listed else found

    def listed(found: Column, show: Callable[[Column], Column]) -> tuple[None, Column]:
        return None, let(found, lambda x: F.when(F.size(x) > 0, show(x)))

    rules = {
        "placeholder": listed(less(placeholders(text), "placeholder"), lambda x: F.array_join(x, "|")),
        "english_residue": listed(less(english_runs(text), "english"), lambda x: F.array_join(F.slice(x, 1, 10), "|")),
        "unbalanced_quotes_or_brackets": (None, bracket_error(text)),
        "unbalanced_emphasis": (None, emphasis_error(text)),
    }
    if simplified:
        rules["simplified_chinese"] = listed(foreign_characters(text, simplified, "".join(allowed.get("simplified", []))), lambda x: F.array_join(x, ""))
    return rules


def report(found: list[DataFrame]) -> DataFrame:
    """Issues by code: (``code``, ``n``)."""
    return reduce(DataFrame.unionByName, found).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def write_report(found: DataFrame, path: str) -> None:
    """The issues as JSON lines under ``path``/issues and their counts under ``path``/checks."""
    found.write.mode("errorifexists").json(f"{path.rstrip('/')}/issues", ignoreNullFields=False)
    report([found]).write.mode("errorifexists").json(f"{path.rstrip('/')}/checks")


def passed(found: DataFrame) -> DataFrame:
    """One row: (``passed``, ``issue_count``)."""
    return found.agg(F.count(F.lit(1)).alias("issue_count")).select((F.col("issue_count") == 0).alias("passed"), "issue_count")


def assert_passed(found: DataFrame) -> None:
    """Raises with the first issues if there are any."""
    first = found.limit(5).collect()
    if first:
        raise ValueError("quality gate: " + "; ".join(f"{r['code']} {r['key']}" for r in first))


def marker_mismatch(books: DataFrame, chunks: DataFrame, by: str, text: str) -> DataFrame:
    """Books whose marker lines are not their chunks in order: (``by``, ``expected``, ``found``)."""
    found = books.select(by, F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(1)).alias("found"))
    expected = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("e")).select(by, F.col("e.chunk_id").alias("expected"))
    return expected.join(found, by, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("found")))
