"""Texts as publication blocks, in hashed batches that can be resumed."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import paragraphs

# Most characters of a run and most blocks of a batch, inline emphasis, lines that are markers, and the
# opening callout.
RUN_LENGTH, BATCH_SIZE = 2000, 100
INLINE = r"\*\*(?P<bold>.+?)\*\*|\*(?P<italic>[^*\n]+?)\*"
MARKER_LINE = r"^<!--\s*chunk-\d{4};.*-->$"
HEADING_LINE = r"^#{1,6}\s+(.+)$"
CALLOUT, ICON = "Traditional Chinese translation of %s by %s.", "📖"
#: What a marker block of a batch begins with.
BATCH_MARK = "inkloom:batch:"

RUN = T.StructType([T.StructField("content", T.StringType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType())])
_INLINE = re.compile(INLINE)


def inline_runs(text: str) -> list[tuple[str, bool, bool]]:
    """A text as (content, bold, italic) runs of at most ``RUN_LENGTH`` characters; an empty one is one empty run."""
    parts, at = [], 0
    for found in _INLINE.finditer(text):
        parts.append((text[at : found.start()], False, False))
        parts.append((found["bold"], True, False) if found["bold"] is not None else (found["italic"], False, True))
        at = found.end()
    parts.append((text[at:], False, False))
    runs = [(content[i : i + RUN_LENGTH], b, e) for content, b, e in parts for i in range(0, len(content), RUN_LENGTH)]
    return runs or [("", False, False)]


@F.pandas_udf(T.ArrayType(RUN))
def runs_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"content": c, "bold": b, "italic": i} for c, b, i in inline_runs(t)])


def plain_of(runs: Column) -> Column:
    """The text of a row of runs."""
    return F.array_join(F.transform(runs, lambda r: r["content"]), "")


def canonical_block(kind: str, content: str) -> str:
    """A block as JSON of what it says: sorted keys, no blanks, five marks a run, and the icon of a callout."""
    out: dict = {"type": kind}
    if kind in ("paragraph", "heading_1", "callout"):
        flags = {"strikethrough": False, "underline": False, "code": False}
        out["rich_text"] = [{"content": c, "bold": b, "italic": i, **flags} for c, b, i in inline_runs(content)]
    if kind == "callout":
        out["icon"] = {"type": "emoji", "emoji": ICON}
    return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_udf(kind: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([canonical_block(k, c) for k, c in zip(kind, content)], dtype=object)


def blocks(books: DataFrame, by: str, text: str, name: str | None = None, author: str | None = None) -> DataFrame:
    """Every paragraph as a block: (``by``, ``pos`` from 1, ``type``, ``content``).

    Marker lines give none; ``* * *`` is a divider, a line of hashes and text a
    heading, anything else a paragraph.  With the columns ``name`` and ``author``
    three blocks come first: a callout that names both, the table of contents and
    a divider.  Null texts give no paragraphs.
    """
    listed = F.filter(F.coalesce(paragraphs(F.col(text)), F.array().cast("array<string>")), lambda p: ~p.rlike(MARKER_LINE))
    kind = lambda p: F.when(p == "* * *", "divider").when(p.rlike(HEADING_LINE), "heading_1").otherwise("paragraph")
    says = lambda p: F.when(p == "* * *", "").when(p.rlike(HEADING_LINE), F.regexp_replace(p, r"^#{1,6}\s+", "")).otherwise(p)
    made = F.transform(listed, lambda p: F.struct(kind(p).alias("type"), says(p).alias("content")))
    if name is not None:
        fixed = (("callout", F.format_string(CALLOUT, F.col(name), F.col(author))), ("table_of_contents", F.lit("")), ("divider", F.lit("")))
        made = F.concat(F.array(*(F.struct(F.lit(k).alias("type"), c.alias("content")) for k, c in fixed)), made)
    rows = books.select(by, F.posexplode(made).alias("_p", "_block"))
    return rows.select(by, (F.col("_p") + 1).cast("long").alias("pos"), "_block.type", "_block.content")


def batches(block_rows: DataFrame, by: str, size: int = BATCH_SIZE) -> DataFrame:
    """Blocks in batches of ``size``: (``by``, ``batch_no`` from 1, ``block_count``, ``batch_hash``).

    The hash is that of the JSON list of the canonical blocks, in order.  ``pos``
    numbers the blocks from 1 without gaps, so the batch follows from it and no
    sort is needed; a group is at most ``size`` blocks.
    """
    each = block_rows.withColumn("batch_no", (F.floor((F.col("pos") - 1) / size) + 1).cast("long")).withColumn("h", canonical_udf("type", "content"))
    return _hashed(each, [by, "batch_no"])


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("block_count"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs"))
    return grouped.select(*keys, "block_count", F.sha2(F.concat(F.lit("["), F.array_join("hs.h", ","), F.lit("]")), 256).alias("batch_hash"))


def marker_text(by: str) -> Column:
    """What the marker block of a batch says: its book, number, size and hash."""
    return F.concat(F.lit(BATCH_MARK), F.concat_ws(":", F.col(by).cast("string"), "batch_no", "block_count", "batch_hash"))


def marked(block_rows: DataFrame, by: str, size: int = BATCH_SIZE) -> DataFrame:
    """Blocks as they are uploaded: every batch behind its marker block (``by``, ``pos``, ``type``, ``content``)."""
    numbered = block_rows.withColumn("batch_no", (F.floor((F.col("pos") - 1) / size) + 1).cast("long"))
    content = numbered.select(by, (F.col("pos") + F.col("batch_no")).alias("pos"), "type", "content")
    marks = batches(block_rows, by, size).select(by, ((F.col("batch_no") - 1) * (size + 1) + 1).alias("pos"), F.lit("paragraph").alias("type"), marker_text(by).alias("content"))
    return content.unionByName(marks)


def discover(children: DataFrame, by: str) -> DataFrame:
    """Batches that a remote body (``by``, ``pos``, ``type``, ``content``) holds, found by their markers.

    Columns: ``by``, ``batch_no``, ``block_count`` and ``batch_hash`` as marked,
    ``marker_pos``, ``present`` (blocks that follow, at most those marked),
    ``read_hash`` (of what follows), ``state``: ``verified``, ``altered``,
    ``incomplete``, ``malformed`` or ``duplicate``.  Every block is matched to the
    last marker before it by a window over its own book; nothing is collected.
    """
    prefix = F.concat(F.lit(BATCH_MARK), F.col(by).cast("string"), F.lit(":"))
    rows = children.withColumn("_marker", F.coalesce((F.col("type") == "paragraph") & F.startswith("content", prefix), F.lit(False)))
    parts = F.split(F.substring("content", F.length(prefix) + 1, F.length("content")), ":", -1)
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    rows = rows.withColumns({"_at": F.when(F.col("_marker"), F.col("pos")), "_n": F.when(F.col("_marker"), number(2))})
    w = Window.partitionBy(by).orderBy("pos")
    rows = rows.withColumns({"_at": F.last("_at", True).over(w), "_n": F.last("_n", True).over(w)})
    inside = rows.filter(~F.col("_marker") & F.col("_at").isNotNull() & (F.col("pos") - F.col("_at") <= F.col("_n")))
    read = _hashed(inside.withColumn("h", canonical_udf("type", "content")), [by, "_at"]).select(by, F.col("_at").alias("marker_pos"), F.col("block_count").alias("present"), F.col("batch_hash").alias("read_hash"))
    marks = rows.filter("_marker").select(by, F.col("pos").alias("marker_pos"), number(1).alias("batch_no"), number(2).alias("block_count"), F.try_element_at(parts, F.lit(3)).alias("batch_hash"), F.size(parts).alias("_size"))
    marks = marks.join(read, [by, "marker_pos"], "left").withColumn("present", F.coalesce("present", F.lit(0)).cast("long"))
    bad = (F.col("_size") != 3) | F.col("batch_no").isNull() | F.col("block_count").isNull()
    again = F.count(F.lit(1)).over(Window.partitionBy(by, "batch_no")) > 1
    state = F.when(bad, "malformed").when(again, "duplicate").when(F.col("present") < F.col("block_count"), "incomplete").when(F.col("read_hash") == F.col("batch_hash"), "verified").otherwise("altered")
    return marks.withColumn("state", state).drop("_size")


def removable(children: DataFrame, by: str) -> DataFrame:
    """Positions (``by``, ``pos``) of the blocks that a replacement may delete: verified batches with their markers, and a marker at the very end that nothing follows.

    Everything else, such as what was written by hand, stays.  Books with a
    malformed, repeated or altered batch give none.
    """
    found = discover(children, by)
    unsafe = found.filter("state in ('malformed', 'duplicate', 'altered')").select(by).distinct()
    last = children.groupBy(by).agg(F.max("pos").alias("_last"))
    kept = found.join(last, by).filter((F.col("state") == "verified") | ((F.col("state") == "incomplete") & (F.col("marker_pos") == F.col("_last")))).join(unsafe, by, "left_anti")
    return kept.select(by, F.explode(F.sequence(F.col("marker_pos"), F.col("marker_pos") + F.col("present"))).alias("pos"))


def merge_batches(expected: DataFrame, remote: DataFrame, by: str) -> DataFrame:
    """Batches against what is already there: ``done``, ``upload``, ``changed`` or ``unexpected``."""
    e, r = expected.alias("e"), remote.alias("r")
    joined = e.join(r, (F.col(f"e.{by}") == F.col(f"r.{by}")) & (F.col("e.batch_no") == F.col("r.batch_no")), "full_outer")
    state = (
        F.when(F.col("r.batch_hash").isNull(), "upload")
        .when(F.col("e.batch_hash").isNull(), "unexpected")
        .when((F.col("e.batch_hash") == F.col("r.batch_hash")) & (F.col("e.block_count") == F.col("r.block_count")), "done")
        .otherwise("changed")
    )
    return joined.select(F.coalesce(f"e.{by}", f"r.{by}").alias(by), F.coalesce("e.batch_no", "r.batch_no").alias("batch_no"), state.alias("state"))


class BlockStore:
    """Where batches go. Implementations talk to a service; this one keeps them in memory for tests."""

    def __init__(self) -> None:
        self.kept: dict[tuple, tuple[int, str]] = {}

    def write(self, book: object, batch_no: int, block_count: int, batch_hash: str) -> None:
        self.kept[(book, batch_no)] = (block_count, batch_hash)

    def rows(self) -> list[tuple]:
        return [(b, n, c, h) for (b, n), (c, h) in sorted(self.kept.items())]


def publish(expected: DataFrame, store: BlockStore, by: str, fail_at: int | None = None) -> int:
    """Uploads what the store lacks and reads it back; returns how many batches were sent.

    A batch is written whole, so a broken run resumes after the last one kept.
    Batches changed or unknown remotely stop it before anything is written.
    """
    spark = expected.sparkSession
    remote = spark.createDataFrame(store.rows(), f"{by} long, batch_no long, block_count long, batch_hash string")
    states = merge_batches(expected, remote, by)
    wrong = states.filter("state in ('changed', 'unexpected')").limit(1).collect()
    if wrong:
        raise ValueError(f"remote batch {wrong[0]['batch_no']} of {wrong[0][by]} is {wrong[0]['state']}")
    todo = states.filter("state = 'upload'").select(by, "batch_no").join(expected, [by, "batch_no"]).orderBy(by, "batch_no")
    sent = 0
    # The service takes one batch after the other; rows stream to the driver a partition at a time.
    for row in todo.toLocalIterator():
        if fail_at is not None and sent == fail_at:
            raise ConnectionError("the service went away")
        store.write(row[by], row["batch_no"], row["block_count"], row["batch_hash"])
        sent += 1
    if sent:
        there = spark.createDataFrame(store.rows(), f"{by} long, batch_no long, block_count long, batch_hash string")
        left = merge_batches(expected, there, by).filter("state <> 'done'").limit(1).collect()
        if left:
            raise ValueError(f"batch {left[0]['batch_no']} of {left[0][by]} was not kept as it was sent")
    return sent


def token_rows(batches_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of texts as rows (``key``, ``pos``, ``content``, ``bold``, ``italic``)."""
    for batch in batches_in:
        rows = [(k, i, *run) for k, t in zip(batch["key"], batch["text"]) if t is not None for i, run in enumerate(inline_runs(t), 1)]
        yield pd.DataFrame(rows, columns=["key", "pos", "content", "bold", "italic"])


def inline_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inline emphasis of texts as one row per run."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(token_rows, "key long, pos int, content string, bold boolean, italic boolean").withColumnRenamed("key", key)
