"""Structured Streaming: late rows, windowed counts, and ordered replay of keyed events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Rows and sums by time window and kind; rows later than ``lateness`` are dropped once their window is final."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, width), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), kind, "n", "total")
    )


def first_copies(events: DataFrame, keys: list[str], time: str, lateness: str = "2 hours") -> DataFrame:
    """Each key once within the watermark, as first seen."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


_OUT = "key long, seen long, total double, last_kind string, idle boolean"
_STATE = "seen long, total double, last_kind string"


def keyed_totals(events: DataFrame, key: str, time: str, kind: str, value: str, idle: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """A running count, sum and last kind for each key.

    A key that stays idle, by event time, until the watermark passes gives a last
    row, and its state ends.
    """
    wait = milliseconds(idle)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, total, last = state.get
            state.remove()
            yield pd.DataFrame([(k[0], seen, total, last, True)], columns=["key", "seen", "total", "last_kind", "idle"])
            return
        seen, total, last = state.get if state.exists else (0, 0.0, None)
        latest = None
        for batch in batches:
            seen += len(batch)
            total += float(batch["value"].fillna(0).sum())
            top = batch.sort_values("time").iloc[-1]
            if latest is None or top["time"] >= latest:
                latest, last = top["time"], top["kind"]
        state.update((seen, total, last))
        due = int(pd.Timestamp(latest).timestamp() * 1000) + wait if latest is not None else 0
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], seen, total, last, False)], columns=["key", "seen", "total", "last_kind", "idle"])

    rows = events.withWatermark(time, lateness).select(F.col(key).cast("long").alias("key"), F.col(time).alias("time"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def milliseconds(text: str) -> int:
    """A duration such as "30 minutes" or "2 hours" in milliseconds."""
    return int(pd.Timedelta(text) / pd.Timedelta(1, "ms"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there into an in-memory table, for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
