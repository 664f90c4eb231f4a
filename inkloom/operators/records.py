"""Records of books: brief fields, metadata, property rows, configuration overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.hashing import book_key
from inkloom.functions.text import strip

# Where a brief and a progress file state what.
YEAR = r"(?i)(?:copyright\s*)?(\d{4})"
ISBN = r"(?i)ISBN\s*`?([^`;]+)`?"
COMPLETED = r"Completed chunks:\s*(\d+)"
COMPLETED_AT = r"(?i)Completed (?:at|on):\s*(\d{4}-\d{2}-\d{2})"
IS_COMPLETE = r"(?mi)^- Status:\s*complete\s*$"
CHAPTER_LINE = r"(?m)^# [一二三四五六七八九十]+$"


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def field(text: Column, name: str, fallback: Column | None = None) -> Column:
    """The value of the line ``- Name: value``, without stars around; the fallback stands in for one that is still to do."""
    value = strip(F.regexp_replace(strip(_found(text, rf"(?m)^- \Q{name}\E:\s*(.+)$")), r"^\*+|\*+$", ""))
    return value if fallback is None else F.when(F.lower(value).startswith("todo"), F.coalesce(F.nullif(strip(fallback), F.lit("")), value)).otherwise(value)


def book_metadata(rows: DataFrame, by: str, brief: str, progress: str, book: str, source_hash: str, locale: str) -> DataFrame:
    """One row per book of what its brief, progress and assembled text tell.

    Columns: ``by``, ``publication_year``, ``isbn``, ``chunk_count``,
    ``completed_at``, ``complete``, ``chapter_count`` and ``book_key``.  What is
    not stated is null.
    """
    edition = F.coalesce(field(F.col(brief), "Source edition"), F.lit(""))
    isbn = F.nullif(F.regexp_replace(strip(_found(edition, ISBN)), "^`+|`+$", ""), F.lit(""))
    return rows.select(
        by,
        _found(edition, YEAR).try_cast("int").alias("publication_year"),
        isbn.alias("isbn"),
        _found(F.col(progress), COMPLETED).try_cast("int").alias("chunk_count"),
        _found(F.col(progress), COMPLETED_AT).try_cast("date").alias("completed_at"),
        F.coalesce(F.col(progress).rlike(IS_COMPLETE), F.lit(False)).alias("complete"),
        F.regexp_count(F.col(book), F.lit(CHAPTER_LINE)).alias("chapter_count"),
        book_key(isbn, edition, F.col(source_hash), F.col(locale)).alias("book_key"),
    )


def property_text(value: Column, most: int = 2000) -> Column:
    """A text property: null for a null or empty value, cut at the service's limit."""
    return F.left(F.nullif(value, F.lit("")), F.lit(most))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Names of a schema that a frame lacks, sorted."""
    return sorted(set(wanted) - set(df.columns))


def overlay(base: dict, override: dict) -> dict:
    """A configuration with another one over it; objects are merged one level deep, other values replaced."""
    return base | {k: base[k] | v if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def resolve_or_title(wanted: DataFrame, known: DataFrame, key: str, title: str, found: str) -> DataFrame:
    """Rows of ``wanted`` with the ``found`` of the record of the same key, else of the same title; several matches raise."""
    by_key = known.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(found).alias("_a"), F.count(F.lit(1)).alias("_na"))
    by_title = known.groupBy(title).agg(F.min(found).alias("_b"), F.count(F.lit(1)).alias("_nb"))
    rows = wanted.join(by_key, key, "left").join(by_title, title, "left")
    several = rows.filter((F.col("_na") > 1) | (F.col("_na").isNull() & (F.col("_nb") > 1))).limit(1).collect()
    if several:
        raise ValueError(f"more than one record for {several[0][key]}")
    return rows.withColumn(found, F.coalesce("_a", "_b")).drop("_a", "_b", "_na", "_nb")


def reviews_with_issues(reviews: DataFrame, issues: str) -> DataFrame:
    """Reviews whose list of issues is not empty."""
    return reviews.filter(F.size(issues) > 0)
