"""Terminology: matches in text, conflicts, consolidation of proposals, new terms."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import casefold, fold_term, strip

#: Terms of a book that travel with one of its texts; a larger dictionary is split into several blocks.
BLOCK = 2_000
_ASCII = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def contains_term(text: Column, term: Column, any_case: bool = True) -> Column:
    """Whether a term stands in a text with no ASCII letter or digit at either side."""
    quoted = F.concat(F.lit("(?iu)" if any_case else ""), F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9])"))
    found = F.regexp_like(text, quoted)
    # A plain substring test first: the pattern differs from row to row and is dear to compile.
    near = F.contains(F.lower(text), F.lower(term)) if any_case else F.contains(text, term)
    return near & found


@lru_cache(maxsize=256)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        if term:
            found.setdefault(term, []).append(i)
    out = ahocorasick.Automaton()
    for term, places in found.items():
        out.add_word(term, (len(term), places))
    if len(out):
        out.make_automaton()
    return out


def _finder(whole: bool):
    """Positions (from 0) of the terms that stand in a text, all of them looked for in one reading of it."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(text: pd.Series, terms: pd.Series) -> pd.Series:
        def one(value: str | None, listed) -> list[int]:
            auto = _automaton(tuple(t or "" for t in listed)) if value is not None else None
            if auto is None or not len(auto):
                return []
            hits: set[int] = set()
            for end, (length, places) in auto.iter(value):
                start = end - length + 1
                if whole and ((start and value[start - 1] in _ASCII) or value[end + 1 : end + 2] in _ASCII):
                    continue
                hits.update(places)
            return sorted(hits)

        return pd.Series([one(v, t) for v, t in zip(text, terms)], dtype=object)

    return find


_WHOLE, _WITHIN = _finder(True), _finder(False)


def approved(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows of approved status, in any case and with blanks around."""
    return df.filter(F.lower(strip(F.col(status))) == "approved")


def term_matches(texts: DataFrame, terms: DataFrame, by: str, text: str, term: str, any_case: bool = True, whole: bool = True) -> DataFrame:
    """Texts with the terms of their own book that stand in them: the columns of both, one row per pair.

    ``whole`` asks for no ASCII letter or digit at either side; ``any_case`` folds
    the case of both.  The dictionary of a book is joined to its texts as blocks
    of about ``BLOCK`` terms, so no row grows with the book, and every text is read
    once a block by an automaton over all its terms, not once a term.  Null texts
    and blank terms match nothing; columns of ``terms`` must not be those of
    ``texts`` but for ``by``.
    """
    # Whole terms fold letter by letter, as an ignored case does in a pattern; parts of a text fold in full.
    single = lambda c: F.translate(F.lower(c), "ς", "σ")
    fold = (single if whole else casefold) if any_case else (lambda c: c)
    usable = terms.filter(F.col(by).isNotNull() & (F.length(strip(F.col(term))) > 0))
    sizes = usable.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    row = F.struct(*(c for c in terms.columns if c != by))
    blocked = usable.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64(row), F.ceil(F.col("_n") / BLOCK)))
    blocks = blocked.groupBy(by, "_block").agg(F.collect_list(row).alias("_terms")).drop("_block")
    joined = texts.join(blocks, by)
    find = _WHOLE if whole else _WITHIN
    hits = joined.withColumn("_hit", F.explode(find(fold(F.col(text)), F.transform("_terms", lambda t: fold(t[term])))))
    return hits.withColumn("_hit", F.get("_terms", F.col("_hit"))).select(*texts.columns, *(F.col(f"_hit.{c}").alias(c) for c in terms.columns if c != by))


def conflicts(df: DataFrame, by: list[str], term: str, target: str, fold: bool = True) -> DataFrame:
    """Terms with more than one target: (``by``, ``term``, ``targets``, ``n_targets``)."""
    key = fold_term(strip(F.col(term))) if fold else F.col(term)
    rows = df.filter(F.length(strip(F.col(term))) > 0).filter(F.length(strip(F.col(target))) > 0)
    grouped = rows.groupBy(*by, key.alias("term")).agg(F.array_sort(F.collect_set(strip(F.col(target)))).alias("targets"))
    return grouped.filter(F.size("targets") > 1).withColumn("n_targets", F.size("targets").cast("long"))


def _counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value of a key occurs, most frequent first, the earlier one where counts are equal."""
    counted = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    ordered = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("v")))).alias("c"))
    return ordered.select(*keys, F.transform("c", lambda e: F.struct(e["v"].alias("value"), (-e["n"]).alias("n"))).alias(value))


def consolidate(proposals: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Proposals of a book merged by folded term.

    ``proposals`` has ``chunk_id``, ``source_term``, ``proposed_target``,
    ``category``, ``confidence`` and ``notes``; ``order`` tells which came first.
    Columns: ``by``, ``term_key``, ``source_term`` (most frequent form),
    ``mentions``, ``source_forms``, ``candidate_targets``, ``categories`` and
    ``confidence`` (arrays of value and count), up to three different ``notes``,
    ``first_chunk``.  Counts are taken per value before anything is collected, so
    a frequent term costs no more than its distinct values.
    """
    rows = proposals.select(
        by,
        fold_term(strip(F.col("source_term"))).alias("term_key"),
        strip(F.col("source_term")).alias("source_forms"),
        strip(F.col("proposed_target")).alias("candidate_targets"),
        F.coalesce("category", F.lit("other")).alias("categories"),
        F.col("confidence").alias("confidence"),
        strip(F.col("notes")).alias("note"),
        "chunk_id",
        F.struct(*order).alias("_at"),
    ).filter(F.length("term_key") > 0)
    keys = [by, "term_key"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"), F.min("chunk_id").alias("first_chunk"))
    for value in ("source_forms", "candidate_targets", "categories", "confidence"):
        base = base.join(_counts(rows, keys, value), keys, "left")
    first = rows.filter(F.length("note") > 0).groupBy(*keys, "note").agg(F.min("_at").alias("_at"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).filter("r <= 3")
    notes = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "note"))).alias("l")).select(*keys, F.col("l.note").alias("notes"))
    return base.join(notes, keys, "left").withColumn("source_term", F.col("source_forms")[0]["value"])


def new_terms(proposals: DataFrame, known: DataFrame, by: str, term: str, known_term: str, order: list[str]) -> DataFrame:
    """First proposal of each term that the book's registry doesn't know, by folded term."""
    keyed = proposals.withColumn("term_key", fold_term(strip(F.col(term)))).filter(F.length("term_key") > 0)
    have = known.select(by, fold_term(strip(F.col(known_term))).alias("term_key")).filter(F.length("term_key") > 0).distinct()
    fresh = keyed.join(have, [by, "term_key"], "left_anti")
    first = Window.partitionBy(by, "term_key").orderBy(*order)
    return fresh.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def targets_missing(texts: DataFrame, terms: DataFrame, by: str, source: str, target: str, term: str, wanted: str) -> DataFrame:
    """Terms that stand in a source whose target text lacks the approved form."""
    hits = term_matches(texts, terms.filter(F.length(F.col(wanted)) > 0), by, source, term)
    return hits.filter(~F.contains(F.col(target), F.col(wanted)))
