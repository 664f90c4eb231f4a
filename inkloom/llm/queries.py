"""The llm queries over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import copies, garbling, lookalikes, mixing, names, scans, splitting, tokens, truncation
from inkloom.session import cut_lineage
from inkloom.session import read_table as table

Query = Callable[[SparkSession, str], DataFrame]


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "glossary").select("entry_id", "book_id", F.col("target_term").alias("target"))
    names = table(spark, folder, "characters").select("entry_id", "book_id", F.col("target_name").alias("target"))
    return terms.unionByName(names)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalikes.look_alike_pairs(_targets(spark, folder), "entry_id", "book_id", "target")
    return pairs.select(F.col("first").alias("first_entry_id"), F.col("second").alias("second_entry_id"))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every target in its consistent form, with its class."""
    return lookalikes.look_alikes(_targets(spark, folder), "entry_id", "book_id", "target").drop("skeleton")


_SPLIT = ("chunk_key", "source")
_LIMITS = ("book_id", "chunk_target_words", "chunk_max_words", "chunk_overlap_words")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "chunks"), *_SPLIT, table(spark, folder, "project"), *_LIMITS)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every chunk."""
    return splitting.split_oversized(table(spark, folder, "chunks"), *_SPLIT, table(spark, folder, "project"), *_LIMITS)


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_names(table(spark, folder, "characters"), "entry_id", "book_id", "source_name", "aliases", "role", "pronouns_or_gender", "target_name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = names.same_name_pairs(_people(spark, folder), "entry_id")
    return pairs.select(F.col("first").alias("first_entry_id"), F.col("second").alias("second_entry_id"))


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of characters with the entity it means."""
    return _people(spark, folder)


def _copy_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the three tables, keyed."""
    fields = ["chunk_id", "source_term", "proposed_target", "category"]
    terms = table(spark, folder, "glossary").select("entry_id", "book_id", F.col("source_term").alias("_t"), "updated_at")
    scans = table(spark, folder, "term_scans").select("scan_id", "book_id", copies.joined_fields(*fields).alias("_t"), "loaded_at")
    records = table(spark, folder, "term_records").select("record_id", "book_id", F.col("record_text").alias("_t"), "received_at")
    plain = copies.letters_and_digits(F.col("_t"), "\u0001")
    rows = copies.keyed(copies.compose(terms, "_t"), "glossary", "entry_id", "book_id", plain, "updated_at")
    rows = rows.unionByName(copies.keyed(copies.compose(scans, "_t"), "term_scans", "scan_id", "book_id", plain, "loaded_at"))
    return rows.unionByName(copies.keyed(copies.compose(records, "_t"), "term_records", "record_id", "book_id", copies.record_key(F.col("_t")), "received_at"))


def _copy_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, copies.Ledger]:
    rows = cut_lineage(_copy_rows(spark, folder))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows, copies.ledger_of(spark, copies.by_arrival(rows), buckets=copies.bucket_count(rows.count(), tasks))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, ledger = _copy_ledger(spark, folder)
    found = cut_lineage(copies.copies_of(rows, ledger))
    ledger.remove()
    return found


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each group of copies with their number."""
    ledger = _copy_ledger(spark, folder)[1]
    found = cut_lineage(ledger.read().select("table_name", "first_id", "copies"))
    ledger.remove()
    return found


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = garbling.garbled_keys(table(spark, folder, "pages"), "page_key", "text", "pages")
    return pages.unionByName(garbling.garbled_keys(table(spark, folder, "chunks"), "chunk_key", "source", "chunks"))


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled rows with their text restored as far as possible."""
    pages = garbling.repair_encoding(table(spark, folder, "pages"), "page_key", "text").withColumnRenamed("page_key", "row_key")
    chunks = garbling.repair_encoding(table(spark, folder, "chunks"), "chunk_key", "source").withColumnRenamed("chunk_key", "row_key")
    named = pages.withColumn("table_name", F.lit("pages")).unionByName(chunks.withColumn("table_name", F.lit("chunks")))
    return named.filter("garbled").select("table_name", "row_key", "restored", "layers", "damaged")


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of pages and chunks with the names that running headers may hold."""
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("table_name"), F.col("page_key").alias("key"), F.col("book_id").alias("book"), "text")
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_key").alias("key"), F.col("book_id").alias("book"), F.col("source").alias("text"))
    books = table(spark, folder, "project").select(F.col("book_id").alias("book"), "book_name", "author")
    return pages.unionByName(chunks).join(books, "book", "left")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.fault_kinds(_scanned(spark, folder))


def p7_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every page and chunk as continuous paragraphs."""
    return scans.repair_scans(_scanned(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def _drawn(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.encode(table(spark, folder, "documents"), "doc_id", "text", count_only=True, carry=["source"])
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(sizes, targets), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn copies of every mix, shuffled."""
    return _drawn(spark, folder)[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and actual share of each source in each mix."""
    return mixing.mix_report(*_drawn(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_evidence(table(spark, folder, "documents"), "doc_id", "text", "source").filter("truncated").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(truncation.truncation_evidence(table(spark, folder, "documents"), "doc_id", "text", "source"), "source")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
