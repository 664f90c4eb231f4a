"""Neighbouring context, assembly and contiguity of ordered pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import head, marker, paragraphs, parse_markers, tail
from inkloom.operators.segment import is_heading

OPENING, ENDING = "(Beginning of book.)", "(End of book.)"


def neighbours(df: DataFrame, by: str, order: list[str], text: str, before: int = 1200, after: int = 900) -> DataFrame:
    """Adds the end of the piece before and the beginning of the one after, or a literal at either end."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumns(
        {
            "before_text": F.coalesce(tail(F.lag(F.coalesce(text, F.lit(""))).over(w), before), F.lit(OPENING)),
            "after_text": F.coalesce(head(F.lead(F.coalesce(text, F.lit(""))).over(w), after), F.lit(ENDING)),
        }
    )


def transitions(df: DataFrame, by: str, order: list[str], text: str, before: int = 600, after: int = 900) -> DataFrame:
    """Pieces that open a chapter, with the end of the one before and their own beginning."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumns({"_n": F.row_number().over(w), "previous_end": tail(F.lag(text).over(w), before), "opening": head(F.col(text), after)})
    return rows.filter((F.col("_n") == 1) | is_heading(F.get(paragraphs(F.col(text)), F.lit(0)))).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; of rows loaded again, the newest."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(o).desc_nulls_last() for o in order))
    return df.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def choose(df: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """For each key the value of the least rank that is not null."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))


def assemble(chunks: DataFrame, by: str) -> DataFrame:
    """Books as one text each: every chunk under its marker line, in order.

    ``chunks`` has ``chunk_id``, ``chunk_index``, ``page_start``, ``page_end``
    and ``source``; null sources are left out. A book is one row.
    """
    pieces = chunks.filter(F.col("source").isNotNull()).withColumn("_piece", F.concat(marker(F.col("chunk_id"), F.col("page_start"), F.col("page_end")), F.lit("\n\n"), F.trim("source")))
    joined = pieces.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "_piece"))).alias("p"))
    return joined.select(by, F.concat(F.array_join("p._piece", "\n\n"), F.lit("\n")).alias("book_text"), F.size("p").cast("long").alias("pieces"))


def markers(books: DataFrame, by: str, text: str) -> DataFrame:
    """Marker lines of assembled books, one row each with their position."""
    return books.select(by, F.posexplode(parse_markers(F.col(text))).alias("pos", "m")).select(by, (F.col("pos") + 1).alias("pos"), "m.chunk_id", "m.page_start", "m.page_end")


def contiguity(df: DataFrame, by: str, index: str, identity: str, tie: str | None = None) -> DataFrame:
    """Rows whose index or id isn't the next one of their group; ``tie`` orders rows alike in both."""
    w = Window.partitionBy(by).orderBy(index, identity, *([tie] if tie else []))
    rows = df.withColumn("expected", F.row_number().over(w))
    return rows.filter((F.col(index) != F.col("expected")) | (F.col(identity) != F.format_string("chunk-%04d", "expected")))


def selected(df: DataFrame, index: str, first: int = 1, last: int | None = None, most: int | None = None) -> DataFrame:
    """Pieces ``first`` to ``last`` by their index, of these the ``most`` first ones."""
    rows = df.filter(F.col(index) >= first)
    rows = rows if last is None else rows.filter(F.col(index) <= last)
    return rows if most is None else rows.orderBy(index).limit(most)


def piece(df: DataFrame, key: str, value: str) -> DataFrame:
    """The one row of a key; raises if there is none."""
    row = df.filter(F.col(key) == value)
    if row.isEmpty():
        raise KeyError(value)
    return row


def opening(df: DataFrame, by: str, order: str, text: str, pieces: int = 3, chars: int = 18_000) -> DataFrame:
    """The beginning of each book, from its first pieces, cut after so many characters: (``by``, ``opening``)."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= pieces)
    joined = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    return joined.select(by, head(F.array_join("p.t", "\n\n"), chars).alias("opening"))


def groups_of(df: DataFrame, by: list[str], order: list[str], size: int, out: str = "batch_no") -> DataFrame:
    """Adds the number, from 1, of the run of ``size`` consecutive rows that a row is in."""
    return df.withColumn(out, (F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size) + 1).cast("long"))
