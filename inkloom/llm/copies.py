"""Duplicates hidden by formatting differences.

Incremental ledger: canonical keys are counted in buckets; each new batch is
aggregated first, then full-outer-joined with the matching buckets only; counts
add up and the earliest representative stays. Rows are keyed once, and what was
keyed is written and serves for the batches and the result.
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.session import cut_lineage, folder_names, remove_folder, shared_folder

_MARK = r"\p{M}"
#: Between two fields of a record: a separator that a field name follows.
_FIELD_CUT = r"(?U)\s*[|;,\n\t]\s*(?=\w[\w \-]{0,60}?\s*[:=])"


def letters_and_digits(text: Column, keep: str = "") -> Column:
    """Lower case, nothing but letters, digits, the accents on them and the characters to ``keep``; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{M}}\p{{N}}{keep}]+", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(df: DataFrame, column: str) -> DataFrame:
    """A column in composed form. Only rows that hold a combining mark visit Python; ASCII ones aren't even searched for it."""
    text = F.col(column)
    marked = F.coalesce((F.octet_length(text) != F.length(text)) & text.rlike(_MARK), F.lit(False))
    return df.filter(~marked).unionByName(df.filter(marked).withColumn(column, _composed(text)))


def joined_fields(*fields: str) -> Column:
    """Several fields as one text, null as empty, with a control character between them."""
    return F.concat_ws("\u0001", *(F.coalesce(F.replace(f, F.lit("\u0001"), F.lit("")), F.lit("")) for f in fields))


def record_key(record: Column) -> Column:
    """Fields of a raw record, names and values levelled, sorted by name, as one string.

    Read are JSON objects and ``name: value`` or ``name=value`` lists parted by
    bars, semicolons, commas, tabs or line ends.  Fields without a value count as
    absent.  What is neither is keyed by its letters and digits.
    """
    text = F.regexp_replace(record, r"(?U)^\s+|\s+$", "")
    parsed = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")
    from_json = F.transform(F.map_entries(parsed), lambda e: F.struct(letters_and_digits(e["key"]).alias("n"), letters_and_digits(e["value"]).alias("v")))

    def pair(part: Column) -> Column:
        return F.struct(
            letters_and_digits(F.regexp_extract(part, r"(?s)^([^:=]*)[:=]", 1)).alias("n"),
            letters_and_digits(F.regexp_extract(part, r"(?s)^[^:=]*[:=](.*)$", 1)).alias("v"),
        )

    listed = F.when(~text.startswith("{"), F.transform(F.split(text, _FIELD_CUT, -1), pair))
    fields = F.array_sort(F.filter(F.coalesce(from_json, listed), lambda f: (f["n"] != "") & (f["v"] != "")))
    joined = F.array_join(F.transform(fields, lambda f: F.concat(f["n"], F.lit("\u0001"), f["v"])), "\u0002")
    return F.coalesce(F.nullif(joined, F.lit("")), letters_and_digits(text))


def keyed(df: DataFrame, table: str, id_col: str, book: str, key: Column, at: str | None = None) -> DataFrame:
    """Rows as (``table_name``, ``id``, ``k1``, ``k2``, ``at``): the key is a 128-bit hash of table, book and canonical text.

    Rows without a book, or whose canonical text is empty, have no copies; their
    key is null, and the ledger leaves them out.  (A filter here would work the
    canonical text out a second time.)
    """
    rows = df.select(
        F.lit(table).alias("table_name"), F.col(id_col).cast("long").alias("id"), F.col(book).cast("string").alias("_book"), key.alias("_key"), (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at")
    )
    there = F.col("_book").isNotNull() & F.col("_key").rlike("[^\u0001\u0002]")
    return rows.select("table_name", "id", F.when(there, F.xxhash64("table_name", "_book", "_key")).alias("k1"), F.when(there, F.xxhash64(F.lit("second"), "_key", "_book", "table_name")).alias("k2"), "at")


def bucket_count(rows: int, tasks: int) -> int:
    """Buckets for so many rows: enough to keep ``tasks`` tasks busy where there is work for them, never more than ten million rows each."""
    return max(1, -(-rows // 10_000_000), min(tasks, rows // 100_000))


class Ledger:
    """Counts of canonical keys, kept in buckets under a shared folder.

    A bucket is a folder of Parquet files.  ``ingest`` writes each touched bucket
    anew in the next version and carries the others over by name only; a version
    is listed when all its buckets are there, so a job that dies leaves the
    former one in force.  ``buckets`` is chosen by ``bucket_count``, so that a
    bucket of keys suits one task; how often a key occurs doesn't matter, as a
    batch is counted before it is moved.
    """

    SCHEMA = "table_name string, k1 long, k2 long, first_id long, copies long"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 1) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.paths: dict[int, str] = {}
        self.version = 0

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The ledger, or some of its buckets: one row per key."""
        paths = [p for b, p in sorted(self.paths.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _bucket(self) -> Column:
        return F.pmod("k1", F.lit(self.buckets)).cast("int")

    def ingest(self, batch: DataFrame) -> None:
        """Adds a batch of (``table_name``, ``id``, ``k1``, ``k2``) rows; those without a key are left out.

        The batch is aggregated before it is shuffled, so a key that holds a
        third of the rows arrives as one row per task.
        """
        keys = ["k1", "k2", "table_name"]
        new = batch.filter("k1 is not null").groupBy(*keys).agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n"))
        touched = list(range(self.buckets))
        if self.paths:
            # Worked out once, so that neither the list of buckets nor the join reads the source again.
            new = cut_lineage(new)
            touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())
            if not touched:
                return
            old = self.read([b for b in touched if b in self.paths])
            merged = old.join(new, keys, "full_outer").select(
                *keys,
                F.coalesce(F.least("first_id", "i"), "first_id", "i").alias("first_id"),
                (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("copies"),
            )
        else:
            merged = new.select(*keys, F.col("i").alias("first_id"), F.col("n").alias("copies"))
        self.version += 1
        target = f"{self.folder}/v{self.version}"
        merged.withColumn("bucket", self._bucket()).repartitionById(self.buckets, F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = [n for n in folder_names(self.spark, target) if n.startswith("bucket=")]
        self.paths |= {int(n.removeprefix("bucket=")): f"{target}/{n}" for n in written}

    def remove(self) -> None:
        """Deletes all that the ledger wrote."""
        remove_folder(self.spark, self.folder)
        self.paths = {}


def ledger_of(spark: SparkSession, batches: list[DataFrame], folder: str | None = None, buckets: int = 1) -> Ledger:
    """A ledger that has taken in all batches in turn."""
    ledger = Ledger(spark, folder, buckets)
    for batch in batches:
        ledger.ingest(batch)
    return ledger


def by_arrival(rows: DataFrame) -> list[DataFrame]:
    """Keyed rows as two batches in the order of their arrival: up to the middle of the time they span, those without a time among them, and after it."""
    ends = rows.agg(F.unix_micros(F.min("at")).alias("lo"), F.unix_micros(F.max("at")).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return [rows]
    late = F.coalesce(F.unix_micros("at") > (ends["lo"] + ends["hi"]) // 2, F.lit(False))
    return [rows.filter(~late), rows.filter(late)]


def copies_of(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """(``table_name``, ``first_id``, ``dup_id``) for every row that isn't the first of its key."""
    several = ledger.read().filter("copies > 1").select("k1", "k2", "first_id")
    return rows.join(several, ["k1", "k2"]).filter(F.col("id") != F.col("first_id")).select("table_name", "first_id", F.col("id").alias("dup_id"))
