"""Session helpers: table access, reliable lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) up to which a small, measured side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only a local session, as in
    tests, may leave it unset; a temporary folder of this machine serves then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    current = context._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="inkloom-shared-")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; it survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, for executors on which it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_inkloom_shipped", False):
        return
    context._inkloom_shipped = True
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="inkloom-code-")) / "inkloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # served to the executors by the driver


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of the shared file system holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system that is no longer needed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes.

    Both are measured on what was written, so the frame is worked out once; a
    larger side is left to a shuffled join, which gives the same rows.
    """
    kept = cut_lineage(df)
    json = F.octet_length(F.to_json(F.struct(*kept.columns)))
    found = kept.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(json), F.lit(0)).alias("b")).first()
    return F.broadcast(kept) if found["n"] <= rows and found["b"] <= size else kept
