"""Text cut off by field limits.

Self-join by prefix: the distinct texts are range-partitioned and sorted, where
a text that is a strict prefix of any other is one of the next.  The values that
start other, longer ones, and how they go on, decide together with how the text
ends, how the lengths of its source pile up at a limit, and marks of omission.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from inkloom.session import broadcast_if_small, cut_lineage

_CLOSERS = r"[\"'”’»」』）)\]*_]*"
#: An end that closes a sentence.
CLOSED = rf"(?U)[.!?…。！？]{_CLOSERS}\s*$"
#: A mark of omission after a cut.
OMISSION = r"(?U)\s*(?:\[\s*(?:\.\.\.|…)\s*\]|(?:…|\.\.\.)(?:\s*(?:read more|continue reading|more))?)\s*$"
#: Marks that prose doesn't use of itself.
SURE_OMISSION = r"(?iU)(?:\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|(?:…|\.\.\.)\s*(?:read more|continue reading|more))\s*$"
#: A word at the end of a sentence, with a mark of omission or the end of the text (a null character) where these follow.
_ENDED_WORD = r"(?U)(?<!\w)\w++[.!?…](?:\s*(?i:read more|continue reading|more)\s*?(?=[\r\n\x00])|\s*\x00)?"
#: Share of a word's sentence ends that must be ellipses within a text for an ellipsis to be a natural end of it.
DOTTED_SHARE = 0.05
#: Last lines that close a text without an end mark: ornaments, notes in brackets, bullets, credits, rows of a table.
CLOSING_LINE = r"(?U)^\s*(?:[\[(（【].*[\])）】]|[*#~=_\-–—·\s]+|[-•*–—]+\s.*|\d+[.)]\s.*|.*\t.*)\s*$"
_BLANK = r"(?U)^\s*$"
#: Last characters in which an end is looked for first.
SEEN = 400
#: Share of a source's texts that a line must end to close them, the least such texts, and how many it must end for each one in which a line goes on after it.
CLOSING_SHARE, CLOSING_TEXTS, CLOSING_RATIO = 0.005, 3, 10


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over one sorted partition of distinct texts: what follows each in the next one, if that is longer by it.

    The last text of the partition is left open (``edge`` 2, with its text) and
    the first one is given along (``edge`` 1), so that partitions can be matched.
    """
    last: tuple | None = None
    names: list[str] = []
    for batch in batches:
        if not len(batch):
            continue
        names = list(batch.columns)
        part, h1, h2, text = (batch[c].tolist() for c in ("part", "h1", "h2", "text"))
        edge, goes_on, shown = [0] * len(text), [None] * len(text), [None] * len(text)
        rows = []
        if last is None:
            rows.append((part[0], h1[0], h2[0], None, 1, text[0]))
        else:
            rows.append((*last[:3], _continuation(last[3], text[0]), 0, None))
        for i in range(len(text) - 1):
            goes_on[i] = _continuation(text[i], text[i + 1])
        last = (part[-1], h1[-1], h2[-1], text[-1])
        rows += zip(part[:-1], h1[:-1], h2[:-1], goes_on[:-1], edge[:-1], shown[:-1])
        yield pd.DataFrame(rows, columns=["part", "h1", "h2", "goes_on", "edge", "shown"])
    if last is not None:
        yield pd.DataFrame([(*last[:3], None, 2, last[3])], columns=["part", "h1", "h2", "goes_on", "edge", "shown"])


def _continuation(text: str, after: str) -> str | None:
    return after[len(text) : len(text) + 1] if len(after) > len(text) and after.startswith(text) else None


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2")]


def longer_copies(df: DataFrame, text: str, partitions: int | None = None) -> DataFrame:
    """(``h1``, ``h2``, ``goes_on``) for each distinct text that is a strict prefix of a longer one.

    ``h1`` and ``h2`` are the text's hash; ``goes_on`` is the character that
    follows it in the longer one.  Equal texts are made one before anything is
    sorted, so a text that holds a third of all rows weighs no more than others;
    texts with a long common beginning are parted by the range partitioning like
    any others.  Between two partitions only the last and first text are
    compared; there are as many of these as partitions.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("rows"))
    ordered = distinct.select("text").repartitionByRange(count, "text").sortWithinPartitions("text")
    rows = ordered.select(F.spark_partition_id().alias("part"), *_text_hashes(F.col("text")), "text").mapInPandas(_neighbours, "part int, h1 long, h2 long, goes_on string, edge int, shown string")
    rows = cut_lineage(rows.filter("goes_on is not null or edge > 0"))  # fixed once: the edges must be those of the same partitions
    # The partition before each one: numbers only, one row a partition. Texts are then matched by it.
    before = rows.filter("edge = 1").select("part").withColumn("before", F.lag("part").over(Window.orderBy("part")))
    firsts = rows.filter("edge = 1").join(before, "part").select(F.col("before").alias("part"), F.col("shown").alias("next")).filter("part is not null")
    edges = rows.filter("edge = 2").join(firsts, "part")
    joined = edges.filter((F.length("next") > F.length("shown")) & F.startswith("next", F.col("shown"))).withColumn("goes_on", F.expr("substring(next, length(shown) + 1, 1)"))
    return rows.filter("edge = 0 and goes_on is not null").select("h1", "h2", "goes_on").unionByName(joined.select("h1", "h2", "goes_on"))


def _ends(rows: DataFrame) -> DataFrame:
    """Adds how each text ends.

    Patterns of the end see the last ``SEEN`` characters; where these don't hold
    the beginning of the last word, a mark of omission set aside, they see the
    whole text, so nothing that lies further back is missed.
    """
    rows = rows.withColumn("_core", F.rtrim(F.col("text"), F.lit(" \t\r\n\x0b\x0c\x85\u00a0\u2028\u2029\u3000")))
    near = F.right("_core", F.lit(SEEN))
    enough = (F.length("_core") <= SEEN) | F.regexp_replace(near, r"(?i)(?:read more|continue reading|more)\s*$", "").rlike(r"(?sU)\W.*[\p{L}\p{N}]")
    rows = rows.withColumn("_tail", F.when(enough, near).otherwise(F.col("_core"))).withColumn("_base", F.regexp_replace("_tail", OMISSION, ""))
    tail, base = F.col("_tail"), F.col("_base")
    last = F.substring_index(F.when(F.contains("_core", F.lit("\r")), F.regexp_replace("_core", r"\r\n?", "\n")).otherwise(F.col("_core")), "\n", -2)
    return rows.withColumns(
        {
            "n_chars": F.length("text"),
            "n_bytes": F.octet_length("text"),
            "base_chars": F.when(F.length("_base") < F.length("_tail"), F.length("_core") - F.length("_tail") + F.length("_base")),
            "closed": tail.rlike(CLOSED),
            "broken": tail.endswith("�"),
            "sure_mark": tail.rlike(SURE_OMISSION) & ~base.rlike(CLOSED),
            "dots_after": F.nullif(F.lower(F.regexp_extract(tail, r"(?U)(\w+)…\s*$", 1)), F.lit("")),
            "_last": last,
        }
    ).withColumns({"last_line": F.substring_index("_last", "\n", -1), "line_before": F.when(F.contains("_last", F.lit("\n")), F.substring_index("_last", "\n", 1))})


def _closing_lines(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Open last lines that close texts by custom: (``line_hash``, ``texts_ended``).

    ``texts`` has one row for each text of a source.  Such a line ends a fixed
    share of a source's texts, and next to no text has a line that begins with it
    and goes on, as lines do that begin like the stub left by a cut.  Both are
    ratios of exact counts, so the size of the corpus doesn't matter; the share
    leaves at most 200 lines a source to look for.
    """
    sizes = texts.groupBy("src").agg(F.count(F.lit(1)).alias("texts"))
    ended = texts.filter("not closed").groupBy("src", "line_hash").agg(F.count(F.lit(1)).alias("n"))
    often = (F.col("n") >= CLOSING_TEXTS) & (F.col("n") >= CLOSING_SHARE * F.col("texts"))
    # One row a source; their number is checked.
    ended = ended.join(broadcast_if_small(sizes), "src").groupBy("line_hash").agg(F.sum("n").alias("texts_ended"), F.max(often).alias("often"))
    found = broadcast_if_small(ended.filter("often").drop("often"))
    shown = broadcast_if_small(texts.filter("not closed").join(found, "line_hash").groupBy("line_hash").agg(F.first("last_line").alias("last_line")))
    lines = rows.select(F.xxhash64("text").alias("h1"), F.explode(F.split("text", r"\r\n?|\n")).alias("line")).withColumn("line", F.rtrim("line"))
    same = (F.left("line", F.lit(1)) == F.left("last_line", F.lit(1))) & (F.length("line") > F.length("last_line")) & F.startswith("line", F.col("last_line"))
    longer = lines.join(shown, same).select("line_hash", "h1").distinct().groupBy("line_hash").agg(F.count(F.lit(1)).alias("longer"))
    return found.join(longer, "line_hash", "left").filter(F.col("texts_ended") >= CLOSING_RATIO * F.coalesce("longer", F.lit(0))).select("line_hash", "texts_ended")


def _dotted_words(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Words that end sentences in an ellipsis of themselves: (``dots_after``, ``dotted``).

    Of the words before a last ellipsis, those for which ellipses within texts
    are a fixed share of all their sentence ends, marks and ends of texts among
    these.  An ellipsis that a mark of omission follows stands for a cut itself.
    """
    asked = ends.filter("dots_after is not null").select("dots_after").distinct()
    words = rows.select(F.explode(F.regexp_extract_all(F.concat("text", F.lit("\x00")), F.lit(_ENDED_WORD), F.lit(0))).alias("w"))
    words = words.select(F.lower(F.regexp_extract("w", r"(?U)^\w+", 0)).alias("dots_after"), F.col("w").endswith("…").cast("long").alias("within"))
    counts = words.join(broadcast_if_small(asked), "dots_after", "left_semi").groupBy("dots_after").agg(F.sum("within").alias("dotted"), F.count(F.lit(1)).alias("ended"))
    return counts.filter((F.col("dotted") > 0) & (F.col("dotted") >= DOTTED_SHARE * F.col("ended"))).select("dots_after", "dotted")


def _limits(texts: DataFrame, size: str) -> DataFrame:
    """Sizes at which the texts given, one row for each of a source, pile up: (``src``, size).

    A size is a limit if at least five texts have it and eight times as many as
    the ten sizes on either side have on average.  Texts without a source are held
    against the limits of all sources.
    """
    counts = texts.groupBy("src", size).agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("src").orderBy(size).rangeBetween(-10, 10)
    found = counts.withColumn("around", (F.sum("n").over(near) - F.col("n")) / 20).filter("n >= 5 and n >= 8 * around").select("src", size)
    return broadcast_if_small(found.unionByName(found.select(F.lit("").alias("src"), size)).distinct())


def truncation_evidence(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per text with its evidence and the verdict ``truncated``.

    Columns: ``key``, ``source``, ``truncated``, ``longer_copy``, ``at_limit``,
    ``omission`` and ``open_end``.  Null, empty and blank texts are not truncated
    and have no evidence; every copy of a cut text gets the same evidence from the
    texts, and that of its own source from the sizes.

    A text is truncated if

    * it ends in a broken character,
    * it ends with a mark of omission after an unfinished sentence,
    * it ends open at a size where its source's texts pile up,
    * a longer text goes on after it within the same line, or
    * it ends in the middle of a sentence, in a source where texts end closed.

    Lines that close a text without an end mark (ornaments, bullets, rows of a
    table, notes in brackets, signatures, and lines that close texts by custom)
    are not the middle of a sentence; a size or a longer text can still show
    that they were cut.

    How a text ends is found out once and written without the text.  All counts
    are exact, over one row for each text of a source.  The tables of words, lines
    and sizes found are broadcast where they are small; beyond it rows without a
    key are spread by their hash, so that none meets another.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(text).alias("text"))
    shown = F.coalesce(~F.col("text").rlike(_BLANK), F.lit(False))
    prefixes = longer_copies(rows, "text")
    signed = F.coalesce((F.length("line_before") <= 30) & F.col("line_before").rlike(r"(?U)^\w[\w ]*,$") & (F.length("last_line") <= 40), F.lit(False))
    # Without a source, only a line that holds a finished sentence before its open end is taken for prose.
    prose = (F.col("src") != "") | F.col("last_line").rlike(r"(?U)[.!?…。！？][\"'”’」]*\s+[\p{Lu}“\"「‘\p{IsHan}]")
    ends = _ends(rows.filter(shown)).withColumns(dict(zip(("h1", "h2"), _text_hashes(F.col("text")))))
    ends = ends.withColumns({"ornament": F.col("last_line").rlike(CLOSING_LINE) | signed, "prose": prose, "line_hash": F.xxhash64("last_line")})
    ends = ends.withColumn("last_line", F.when(~F.col("closed"), F.col("last_line")))
    ends = cut_lineage(ends.drop("text", "_core", "_tail", "_base", "_last", "line_before"))  # no texts any more, read several times below
    texts = cut_lineage(ends.drop("key", "source").distinct())  # one row for each text of a source: all else follows from these
    dotted = broadcast_if_small(_dotted_words(rows.filter(shown), texts).withColumnRenamed("dots_after", "word"))
    lines = broadcast_if_small(_closing_lines(texts, rows.filter(shown)))

    def judged(x: DataFrame) -> DataFrame:
        spread = F.concat(F.lit("\x00"), F.col("h1").cast("string"))
        x = x.withColumn("word", F.coalesce("dots_after", spread)).join(dotted, "word", "left").join(lines, "line_hash", "left")
        # A word that sentences don't end in with an ellipsis: the ellipsis stands for what was cut.
        marked = F.coalesce(F.col("sure_mark") | (F.col("dots_after").isNotNull() & F.col("dotted").isNull()), F.lit(False))
        return x.withColumns({"omission": marked, "closing": F.col("ornament") | F.col("texts_ended").isNotNull()}).drop("word", "dotted", "dots_after", "texts_ended", "last_line", "ornament", "sure_mark")

    texts = cut_lineage(judged(texts).select("src", "n_chars", "n_bytes", "base_chars", "closed", "closing"))
    hanging = texts.filter("not closed and not closing")
    by_chars = _limits(hanging, "n_chars").withColumn("c1", F.lit(True))
    by_bytes = _limits(hanging, "n_bytes").withColumn("c2", F.lit(True))
    by_base = _limits(texts.filter("base_chars is not null"), "base_chars").withColumnRenamed("base_chars", "base").withColumn("c3", F.lit(True))

    def placed(x: DataFrame) -> DataFrame:
        spread = -F.pmod(F.hash("src", "n_chars", "n_bytes"), F.lit(1 << 30)) - 1
        x = x.withColumn("base", F.coalesce("base_chars", spread))
        x = x.join(by_chars, ["src", "n_chars"], "left").join(by_bytes, ["src", "n_bytes"], "left").join(by_base, ["src", "base"], "left")
        limit = (F.coalesce("c1", "c2", F.lit(False)) & ~F.col("closed")) | F.coalesce("c3", F.lit(False))
        return x.withColumn("at_limit", limit).withColumn("unfinished", ~F.col("closed") & ~F.col("closing") & ~F.col("at_limit")).drop("c1", "c2", "c3", "base")

    ends = placed(judged(ends))
    # Sources in which most texts end open by habit, as posts do, show nothing by an open end.
    habits = ends.groupBy("src").agg((F.avg(F.col("unfinished").cast("int")) > 0.5).alias("open_habit"))
    ends = ends.join(broadcast_if_small(habits), "src", "left").join(prefixes, ["h1", "h2"], "left")
    goes_on = F.coalesce(~F.col("goes_on").isin("\n", "\r"), F.lit(False)) & ~F.col("closed")
    truncated = F.col("broken") | F.col("omission") | F.col("at_limit") | goes_on | (F.col("unfinished") & ~F.col("open_habit") & F.col("prose"))
    flags = ["truncated", "longer_copy", "at_limit", "omission", "open_end"]
    blank = rows.filter(~shown).select(F.col("key").alias(key), F.col("source").alias(source), *(F.lit(False).alias(f) for f in flags))
    seen = ends.select(F.col("key").alias(key), F.col("source").alias(source), truncated.alias("truncated"), goes_on.alias("longer_copy"), "at_limit", "omission", (~F.col("closed")).alias("open_end"))
    return seen.unionByName(blank)


def truncation_rates(evidence: DataFrame, source: str) -> DataFrame:
    """For each source, null among them: its texts, how many are truncated, and the share."""
    return evidence.groupBy(source).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.col("truncated").cast("long")).alias("truncated_texts"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncated_share"),
    )
