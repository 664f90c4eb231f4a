"""Paged text to paragraphs, units and word-bounded chunks, for many books at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.hashing import hash_parts
from inkloom.functions.text import casefold, join_wrapped, normalize_page, paragraphs, strip, unify_newlines, word_count

# Headings that open a chapter or end the book.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty".split()
CHAPTER_WORDS = "prologue epilogue foreword afterword introduction".split()
STOP_TITLES = ["acknowledgments", "acknowledgements", "also by the author", "bibliography", "index"]
BOILERPLATE = ["ABC Amber LIT Converter", "http://www.processtext.com/abclit.html"]

CHAPTER_TITLES = [*NUMBER_WORDS, *(t if n is None else f"{t}-{n}" for t in TENS for n in (None, *NUMBER_WORDS[:9]) if t != "fifty" or n is None), *CHAPTER_WORDS, "about the author"]
CHAPTER_PATTERN = r"^(?:(?i:chapter|part|book)\s+(?i:\d+|[ivxlcdm]+|[a-z][a-z -]{0,30})|\d{1,3}|[IVXLCDM]{1,10})$"
WORKER_HEADING = r"(?i)^(?:chapter\s+)?(?:[ivxlcdm]+|[a-z]+(?:-[a-z]+)?)$"
STOP_PATTERN = r"(?i)^about\s+the\s*authors?$"
PARAGRAPH_END = r"(?:[.!?…—][\"'”’)]*|\. \. \.)\s*$"
SENTENCE_CUT = r"(?U)(?<=[.!?])\s+(?=[\"'“‘A-Z0-9])"
#: A page that ends with its paragraph: in a blank line.
PAGE_END = r"\n[ \t]*\n[ \t]*\n?\z"
#: No listed title is longer than this; longer paragraphs need no folding to tell.
LONGEST_TITLE = 40


def is_heading(text: Column) -> Column:
    """Whether a paragraph is a chapter heading."""
    own = strip(text)
    return F.when(F.length(own) <= LONGEST_TITLE, casefold(own).isin(CHAPTER_TITLES)).otherwise(F.lit(False)) | own.rlike(CHAPTER_PATTERN)


def is_stop_heading(text: Column) -> Column:
    """Whether a paragraph opens what follows the book's text."""
    own = strip(text)
    return F.when(F.length(own) <= LONGEST_TITLE, casefold(own).isin(STOP_TITLES)).otherwise(F.lit(False)) | own.rlike(STOP_PATTERN)


def opens_chapter(text: Column) -> Column:
    """The wider test of drafts: whether the first paragraph of a source is one word, or a chapter line."""
    return F.coalesce(strip(F.get(paragraphs(text), F.lit(0))).rlike(WORKER_HEADING), F.lit(False))


def can_end_paragraph(line: Column) -> Column:
    return line.rlike(PARAGRAPH_END)


def split_pages(df: DataFrame, by: str, text: str) -> DataFrame:
    """Whole texts as pages (``by``, ``page`` from 1, ``text``), parted by form feeds.

    A byte-order mark goes, line ends become LF, one blank page at the end is
    dropped; an empty text is one empty page.
    """
    whole = unify_newlines(F.regexp_replace(F.col(text), "^\ufeff", ""))
    parts = F.split(whole, "\f", -1)
    last_blank = (F.size(parts) > 1) & (strip(F.element_at(parts, -1)) == "")
    parts = F.when(last_blank, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return df.select(by, F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)


def page_range(pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Pages ``first`` to ``last`` under their own numbers."""
    kept = pages.filter(F.col("page") >= first)
    return kept if last is None else kept.filter(F.col("page") <= last)


def continuation(pages: DataFrame, by: str, page: str, text: str, normalized: str, out: str = "continues") -> DataFrame:
    """Adds whether a page goes on with the paragraph of the page before.

    It does unless it is the first of its book, the page before (``text``, as it
    came) ends in a blank line, or the last block before or the first one here
    (of ``normalized``) is a heading.  A page without a block is no heading, so the
    pages on either side of it go on.  Null texts count as empty.
    """
    blocks = paragraphs(F.coalesce(normalized, F.lit("")))
    w = Window.partitionBy(by).orderBy(page)
    edge = lambda c: F.coalesce(is_heading(c), F.lit(False))
    rows = pages.withColumn("_blocks", blocks).withColumns(
        {
            "_head": edge(F.get("_blocks", F.lit(0))),
            "_tail": edge(F.element_at(F.when(F.size("_blocks") > 0, F.col("_blocks")), -1)),
            "_ended": F.coalesce(F.col(text).rlike(PAGE_END), F.lit(False)),
        }
    )
    before_tail, before_ended = F.lag("_tail").over(w), F.lag("_ended").over(w)
    flag = F.coalesce(~before_ended & ~before_tail & ~F.col("_head"), F.lit(False))
    return rows.withColumn(out, flag).drop("_blocks", "_head", "_tail", "_ended")


def positioned_paragraphs(lines: DataFrame, by: list[str], indent: float = 92.0, gap: float = 20.0) -> DataFrame:
    """Positioned lines (``by``, ``line_no``, ``text``, ``x0``, ``top``) as paragraphs.

    A paragraph opens at the first line, at and after a heading, and at an indent
    or a gap if the line before can end one. Columns: ``by``, ``para``, ``text``
    and ``continues``, true for a page whose first line is no heading and not
    indented.
    """
    rows = lines.filter((F.length(strip(F.col("text"))) > 0) & ~strip(F.col("text")).isin(BOILERPLATE))
    rows = rows.withColumn("text", strip(F.col("text")))
    w = Window.partitionBy(*by).orderBy("line_no")
    before = F.lag("text").over(w)
    opens = (
        before.isNull()
        | is_heading(F.col("text"))
        | is_heading(before)
        | ((F.col("x0") >= indent) & can_end_paragraph(before))
        | ((F.col("top") - F.lag("top").over(w) > gap) & can_end_paragraph(before))
    )
    rows = rows.withColumn("_open", opens.cast("int")).withColumn("para", F.sum("_open").over(w))
    firsts = rows.withColumn("continues", F.first(~is_heading(F.col("text")) & (F.col("x0") < indent)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    grouped = firsts.groupBy(*by, "para").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.first("continues").alias("continues"))
    return grouped.select(*by, "para", join_wrapped(F.col("l.text")).alias("text"), "continues")


def book_paragraphs(pages: DataFrame, by: str) -> DataFrame:
    """Paragraphs (``by``, ``pos``, ``page_start``, ``page_end``, ``text``) of paged books.

    ``pages`` has ``page``, ``text`` and ``continues``.  The first block of a page
    that goes on with the one before is joined to its paragraph; everything from
    the first stop heading on is left out.
    """
    blocks = pages.select(by, "page", "continues", F.posexplode(paragraphs(F.col("text"))).alias("block", "text"))
    w = Window.partitionBy(by).orderBy("page", "block")
    joins = F.coalesce(F.col("continues"), F.lit(False)) & (F.col("block") == 0)
    rows = blocks.withColumn("_n", F.row_number().over(w)).withColumn("_opens", ((~joins) | (F.col("_n") == 1)).cast("int"))
    rows = rows.withColumn("_stop", F.when(is_stop_heading(F.col("text")) & (F.col("_opens") == 1), 1).otherwise(0))
    rows = rows.withColumn("_past", F.sum("_stop").over(w)).filter("_past = 0").withColumn("pos", F.sum("_opens").over(w))
    grouped = rows.groupBy(by, "pos").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_parts")
    )
    return grouped.select(by, "pos", "page_start", "page_end", join_wrapped(F.col("_parts.text")).alias("text"))


def sentence_units(text: Column, most: Column) -> Column:
    """A text as units of at most ``most`` words, cut between sentences.

    A text within the limit is one unit.  Sentences are packed greedily; one that
    is too long is cut every ``most`` blank-separated words.  Words are counted
    once a sentence; the fold only adds the counts up.
    """
    counted = F.transform(F.split(text, SENTENCE_CUT, -1), lambda s: F.struct(s.alias("s"), word_count(s).alias("w")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def windows(sentence: Column) -> Column:
        tokens = F.filter(F.split(sentence, r"(?U)\s+", -1), lambda t: t != "")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), most), lambda i: F.array_join(F.slice(tokens, i + 1, most), " "))

    def add(state: Column, unit: Column) -> Column:
        full, long = (state["now"] != "") & (state["n"] + unit["w"] > most), unit["w"] > most
        done = F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"])
        now, n = F.when(full, F.lit("")).otherwise(state["now"]), F.when(full, F.lit(0)).otherwise(state["n"])
        return F.struct(
            F.when(long, F.concat(done, windows(unit["s"]))).otherwise(done).alias("done"),
            F.when(long, now).when(now == "", unit["s"]).otherwise(F.concat_ws(" ", now, unit["s"])).alias("now"),
            F.when(long, n).otherwise(n + unit["w"]).alias("n"),
        )

    packed = F.aggregate(counted, start, add, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    return F.when(word_count(text) <= most, F.array(text)).otherwise(F.filter(packed, lambda u: strip(u) != ""))


def chunk_numbers(words: Column, headings: Column, target: Column, most: Column) -> Column:
    """Chunk number, from 1, of each unit of a text by greedy filling.

    A chunk closes before a heading, where the next unit would pass ``most``
    words, or once it has ``target``.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("n"))

    def add(state: Column, unit: Column) -> Column:
        close = (state["chunk"] == 0) | unit["h"] | (state["n"] + unit["w"] > most) | (state["n"] >= target)
        chunk = state["chunk"] + F.when(close, 1).otherwise(0)
        return F.struct(F.array_append(state["out"], chunk).alias("out"), chunk.alias("chunk"), (F.when(close, F.lit(0)).otherwise(state["n"]) + unit["w"]).alias("n"))

    units = F.zip_with(words, headings, lambda w, h: F.struct(w.cast("int").alias("w"), F.coalesce(h, F.lit(False)).alias("h")))
    return F.aggregate(units, start, add, lambda s: s["out"])


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units in the order of their book as chunks; one chunk at a time is held, also across batches."""
    book, number, words, parts, pages = None, 0, 0, [], (0, 0)

    def closed() -> tuple:
        return (book, number, *pages, "\n\n".join(parts))

    for batch in batches:
        out = []
        for by, first, last, text, w, heading, target, most in batch.itertuples(index=False, name=None):
            if by != book or number == 0:
                if parts:
                    out.append(closed())
                book, number, words, parts = by, 1, 0, []
            elif heading or words + w > most or words >= target:
                out.append(closed())
                number, words, parts = number + 1, 0, []
            pages = (pages[0] if parts else first, last)
            parts.append(text)
            words += w
        yield pd.DataFrame(out, columns=["by", "chunk_index", "page_start", "page_end", "source"])
    if parts:
        yield pd.DataFrame([closed()], columns=["by", "chunk_index", "page_start", "page_end", "source"])


def make_chunks(units: DataFrame, by: str, target: Column, most: Column) -> DataFrame:
    """Ordered units (``by``, ``pos``, ``page_start``, ``page_end``, ``text``) as chunks.

    Columns: ``by``, ``chunk_id``, ``chunk_index``, ``page_start``, ``page_end``,
    ``source_words``, ``source_chars``, ``source_sha256``, ``source``.  ``target``
    and ``most`` may be columns of the book; a chunk closes before a heading,
    where the next unit would pass ``most`` words, or once it has ``target``.

    Words are counted in the JVM.  The units of a book are sorted (on disk where
    need be) and filled in one pass that holds one chunk, so a book may be of any
    size; it is read by one task, since where a chunk begins depends on all
    before it.  Rows without a book give none.
    """
    kind = dict(units.dtypes)[by]
    counted = units.filter(F.col(by).isNotNull()).select(
        F.col(by).alias("by"), "pos", F.col("page_start").cast("int"), F.col("page_end").cast("int"), "text",
        word_count(F.col("text")).cast("long").alias("w"), is_heading(F.col("text")).alias("h"), target.cast("long").alias("t"), most.cast("long").alias("m"),
    )
    ordered = counted.repartition("by").sortWithinPartitions("by", "pos").drop("pos")
    chunks = ordered.mapInPandas(_fill, f"by {kind}, chunk_index int, page_start int, page_end int, source string")
    return chunks.select(
        F.col("by").alias(by),
        F.format_string("chunk-%04d", "chunk_index").alias("chunk_id"),
        "chunk_index",
        "page_start",
        "page_end",
        word_count(F.col("source")).alias("source_words"),
        F.length("source").alias("source_chars"),
        hash_parts(F.col("source")).alias("source_sha256"),
        "source",
    )


def chunk_books(pages: DataFrame, by: str, limits: DataFrame, target: str, most: str) -> DataFrame:
    """Pages (``page``, ``text``) to chunks by each book's own limits.

    Pages are normalised, paragraphs run on across pages, one above the book's
    ``most`` words is cut between sentences, and chunks are filled greedily. Books
    without limits, and pages without a book, give none.
    """
    level = pages.withColumn("_normal", normalize_page(F.coalesce("text", F.lit(""))))
    level = continuation(level, by, "page", "text", "_normal", "continues").select(by, "page", "continues", F.col("_normal").alias("text"))
    bounds = limits.select(by, F.col(target).alias("_target"), F.col(most).alias("_most")).filter("_target is not null and _most > 0")
    whole = book_paragraphs(level, by).join(bounds, by)
    split = whole.select(by, "pos", "page_start", "page_end", "_target", "_most", F.posexplode(sentence_units(F.col("text"), F.col("_most"))).alias("part", "text"))
    ordered = split.withColumn("pos", F.struct("pos", "part"))
    return make_chunks(ordered, by, F.col("_target"), F.col("_most"))
