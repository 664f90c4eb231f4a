"""Several values packed in one field.

Ordinary characters are masked, so that values of the same layout share one
delimiter skeleton.  The splitting rule of a skeleton is worked out once, in
Python, over the distinct skeletons only; the rows then take their values by
position with JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.session import broadcast_if_small

# Characters that may part values, and pairs of quotation marks.
DELIMITERS = ",;|/，、；｜\n\t\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»"}
SPECIAL = DELIMITERS + "".join(dict.fromkeys([*QUOTES, *QUOTES.values()])) + "[]\\"

_CLASS = "".join("\\" + c if c in "[]\\^-" else c for c in SPECIAL)
#: One token: a special character, or a run of others.
TOKEN = f"[{_CLASS}]|[^{_CLASS}]+"

RULE_SCHEMA = "skeleton string, rule array<struct<first:int, count:int, unescape:string>>"


def skeleton_of(tokens: Column) -> Column:
    """Special characters as they are, blank runs as a blank, other runs as ``x``."""
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike(f"^[{_CLASS}]$"), t).when(t.rlike(r"(?U)^\s*$"), " ").otherwise("x"),
        ),
        "",
    )


def split_rule(skeleton: str) -> list[tuple[int, int, str]]:
    """Values of a skeleton as (first token, number of tokens, what to unescape).

    * A skeleton in square brackets is a JSON array of strings: values stand in
      double quotes, a backslash escapes the next character.
    * Elsewhere a value opens with a quotation mark only where a value may
      begin; the mark closes it where the next thing is a delimiter or the end.
      Delimiters in between belong to the value, doubled marks stand for one.
    * A mark within a value, or one that nothing closes, is ordinary.
    * Empty values are left out.
    """
    body = skeleton.strip(" ")
    if body.startswith("[") and body.endswith("]"):
        found = _json_rule(skeleton)
        if found is not None:
            return found
    out, at, n = [], 0, len(skeleton)
    while at < n:
        start = at
        while start < n and skeleton[start] == " ":
            start += 1
        close = _closing(skeleton, start) if start < n and skeleton[start] in QUOTES else -1
        if close >= 0:
            mark = QUOTES[skeleton[start]]
            if close > start + 1 and skeleton[start + 1 : close].strip(" "):
                out.append((start + 1, close - start - 1, mark if mark == skeleton[start] else ""))
            at = close + 1
            while at < n and skeleton[at] not in DELIMITERS:
                at += 1
        else:
            at = start
            while at < n and skeleton[at] not in DELIMITERS:
                at += 1
            if skeleton[start:at].strip(" "):
                out.append((start, at - start, ""))
        at += 1
    return out


def _closing(skeleton: str, start: int) -> int:
    """Where the quotation opened at ``start`` ends; -1 if nowhere."""
    mark, n, at = QUOTES[skeleton[start]], len(skeleton), start + 1
    same = mark == skeleton[start]
    while at < n:
        if skeleton[at] == mark:
            if same and at + 1 < n and skeleton[at + 1] == mark:
                at += 2
                continue
            after = at + 1
            while after < n and skeleton[after] == " ":
                after += 1
            if after == n or skeleton[after] in DELIMITERS:
                return at
        at += 1
    return -1


def _json_rule(skeleton: str) -> list[tuple[int, int, str]] | None:
    """The rule of a JSON array of strings, or None if it isn't one."""
    out, at, n = [], skeleton.index("[") + 1, len(skeleton.rstrip(" ")) - 1
    while at < n:
        if skeleton[at] in " ,\n\t\r":
            at += 1
        elif skeleton[at] == '"':
            first = at = at + 1
            while at < n and skeleton[at] != '"':
                at += 2 if skeleton[at] == "\\" else 1
            if at >= n:
                return None
            if skeleton[first:at].strip(" "):
                out.append((first, at - first, "\\"))
            at += 1
        else:
            return None
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {
                "skeleton": batch["skeleton"],
                "rule": [[{"first": f + 1, "count": c, "unescape": u} for f, c, u in split_rule(s)] for s in batch["skeleton"]],
            }
        )


def split_packed(df: DataFrame, key: str, packed: str, value: str = "value", broadcast_rows: int = 50_000) -> DataFrame:
    """One row (``key``, ``pos``, ``value``) per value packed in the column ``packed``.

    ``pos`` counts from 1 in the order given.  Null, empty and blank fields give
    no row; nor do empty values between delimiters.  Rows that repeat a key give
    their values each.  Other columns, whatever their names, are not read.

    The table of rules has one row per distinct skeleton.  It is broadcast if it
    is counted at no more than ``broadcast_rows``; else it is joined by shuffle.
    """
    rows = (
        df.select(F.col(key).alias("_key"), F.col(packed).alias("_packed"))
        .filter(F.col("_packed").rlike(r"(?U)\S"))
        .withColumn("_tokens", F.regexp_extract_all("_packed", F.lit(TOKEN), F.lit(0)))
        .withColumn("skeleton", skeleton_of(F.col("_tokens")))
    )
    rules = rows.select("skeleton").distinct().mapInPandas(_rules, RULE_SCHEMA)
    rules = broadcast_if_small(rules, broadcast_rows)
    joined = rows.select("_key", "_tokens", "skeleton").join(rules, "skeleton")
    raw = joined.select("_key", "_tokens", F.posexplode("rule").alias("_pos", "_rule"))
    text = F.array_join(F.slice("_tokens", F.col("_rule.first"), F.col("_rule.count")), "")
    text = (
        F.when(F.col("_rule.unescape") == "\\", unescape_json(text))
        .when(F.col("_rule.unescape") == "", text)
        .otherwise(F.replace(text, F.concat(F.col("_rule.unescape"), F.col("_rule.unescape")), F.col("_rule.unescape")))
    )
    return raw.select(
        F.col("_key").alias(key),
        (F.col("_pos") + 1).cast("int").alias("pos"),
        F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias(value),
    )


def unescape_json(text: Column) -> Column:
    """A JSON string's content with its escapes resolved; as it stands if it is malformed."""
    return F.coalesce(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")[0], text)
