"""Readers and writers with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions.loose_json import is_object
from inkloom.operators.segment import page_range, split_pages

CHUNK_SCHEMA = "chunk_id string, index int, page_start int, page_end int, source_words int, source_chars int, source_sha256 string, source string"
GLOSSARY_SCHEMA = "source_term string, target_term string, category string, status string, first_chunk string, notes string"
CHARACTER_SCHEMA = "source_name string, target_name string, aliases string, pronouns_or_gender string, role string, status string, notes string"
TERMINOLOGY_SCHEMA = (
    "terms array<struct<source_term:string,target_term:string,category:string,notes:string>>,"
    "characters array<struct<source_name:string,target_name:string,aliases:string,role:string,notes:string>>"
)


def read_text_pages(spark: SparkSession, path: str, first: int = 1, last: int | None = None, first_line: int | None = None, last_line: int | None = None) -> DataFrame:
    """Whole text files as pages (``path``, ``page``, ``text``).

    Line bounds are counted from 1 over the whole file and are inclusive; pages
    keep their numbers.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if first_line is not None or last_line is not None:
        lines = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n", -1)
        start = (first_line or 1) - 1
        kept = F.slice(lines, F.lit(start + 1), (F.lit(last_line) if last_line else F.size(lines)) - start)
        skipped = F.regexp_count(F.array_join(F.slice(lines, F.lit(1), F.lit(start)), "\n"), F.lit("\f")) if start else F.lit(0)
        raw = raw.select("path", F.array_join(kept, "\n").alias("value"), skipped.alias("_skipped"))
        pages = split_pages(raw, "path", "value").join(raw.select("path", "_skipped"), "path")
        pages = pages.withColumn("page", F.col("page") + F.col("_skipped")).drop("_skipped")
    else:
        pages = split_pages(raw, "path", "value")
    return page_range(pages, first, last)


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """JSON lines as rows and, apart, the lines that are none: (rows, bad lines with ``path``, ``line_no``, ``line``).

    Files are split as the file system likes, so one of any size is read by many
    tasks.  A line's number is its rank in its file by where its split begins and
    where it stands there; the blank lines before it in its split count, as do
    those of earlier splits.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")
    # Ids rise within a split; lines of earlier splits of the file are added up from one row a split.
    sized = raw.groupBy("path", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sized.select("path", "_split", "_first", before.alias("_before"))
    lines = raw.filter(F.length(F.trim("value")) > 0).join(starts, ["path", "_split"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), F.col("value").alias("line"))
    parsed = lines.withColumn("row", F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.filter(F.col("row").isNotNull() & F.col("row._corrupt").isNull()).select("path", "line_no", "row.*").drop("_corrupt")
    bad = parsed.filter(F.col("row").isNull() | F.col("row._corrupt").isNotNull()).select("path", "line_no", "line")
    return good, bad


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines under a new path; characters are kept, null fields written.

    The commit protocol renames finished files, so a broken job leaves nothing
    that a reader takes for whole.
    """
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``sha256``, ``size``) of files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def text_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``pages``) of text files."""
    return read_text_pages(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("pages"))


def source_kind(config: dict) -> tuple[str, str]:
    """Where a book's source lies and of which kind it is: named as text or PDF, else told by its suffix."""
    for name, kind in (("source_text", "text"), ("source_pdf", "pdf")):
        if config.get(name):
            return config[name], kind
    path = config.get("source_file")
    if not path:
        raise ValueError("no source is configured")
    return path, "pdf" if path.lower().endswith(".pdf") else "text"


def read_lines(df: DataFrame, by: list[str], gap: float = 20.0, indent: float = 92.0) -> DataFrame:
    """Pages of positioned lines (``by``, ``line_no``, ``text``, ``x0``, ``top``), as a PDF reader gives them, as page texts (``by``, ``text``, ``continues``)."""
    from inkloom.operators.segment import positioned_paragraphs

    paras = positioned_paragraphs(df, by, indent, gap)
    pages = paras.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("p"), F.first("continues").alias("continues"))
    return pages.select(*by, F.array_join("p.text", "\n\n").alias("text"), "continues")


def read_registry(spark: SparkSession, path: str, schema: str = GLOSSARY_SCHEMA, only_approved: bool = False) -> DataFrame:
    """A CSV registry with a header; an empty frame where the file is missing."""
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path.removeprefix("file://"):
        return spark.createDataFrame([], schema)
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.filter(F.lower(F.trim("status")) == "approved") if only_approved else rows


def read_terminology(spark: SparkSession, path: str) -> DataFrame:
    """Generated terminology in glossary shape, terms first, then characters."""
    whole = spark.read.schema(TERMINOLOGY_SCHEMA).json(path, multiLine=True)
    terms = whole.select(F.inline("terms")).select("source_term", "target_term", "category", "notes")
    names = whole.select(F.inline("characters")).select(F.col("source_name").alias("source_term"), F.col("target_name").alias("target_term"), F.lit("character").alias("category"), "notes")
    return terms.unionByName(names).withColumn("generated", F.lit(True))


def read_fields(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Adds the first value of each ``- Name: value`` line of a text; null where there is none."""
    return df.withColumns({n: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^- {n}:[^\S\n]*(.+)$", 1)), F.lit("")) for n in names})


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """JSON artifacts, a file each, in the order of their names: (``name``, ``text``, ``value``, ``invalid``).

    ``invalid`` is true for what is no JSON object; a missing file has no row.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    rows = rows.withColumn("value", F.try_parse_json("text"))
    return rows.withColumn("invalid", ~is_object(F.col("value"))).orderBy("name")


def write_once(df: DataFrame, folder: str, identity: str) -> str:
    """Writes under a content id unless it is there already; returns the path."""
    path = f"{folder.rstrip('/')}/{identity}"
    df.write.mode("ignore").parquet(path)
    return path


def append_registry(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> DataFrame:
    """A registry with the rows of ``new`` it lacks, written to a new path, never over the one being read."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns)
    merged = old.unionByName(fresh)
    merged.write.mode("errorifexists").parquet(path)
    return merged.sparkSession.read.parquet(path)


def page_statistics(pages: DataFrame, by: list[str], text: str, low: int = 80) -> DataFrame:
    """Pages, characters, upper median, low-text pages and whether more than half of the pages are such.

    The median is the value at position n // 2 of the sorted lengths, from ranks:
    no list of pages is collected.
    """
    rows = pages.withColumn("_c", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy("_c"))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("_c").alias("characters"),
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_c"))).alias("median_characters"),
        F.sum((F.col("_c") < low).cast("long")).alias("low_pages"),
        (F.sum((F.col("_c") < low).cast("long")) / F.count(F.lit(1)) > 0.5).alias("likely_scanned"),
    )
