"""Model calls as a stage over rows, behind an interface with a local fake."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.hashing import hash_parts

#: A client takes (model, instructions, input) and gives the output text.
Client = Callable[[str, str, str], str]


def echo_client(model: str, instructions: str, text: str) -> str:
    """A deterministic stand-in for a service."""
    return f"[{model}] {text}"


def model_of(roles: dict[str, str], role: str, fallback: str = "default") -> str:
    """The model of a role, else that of the fallback role."""
    return roles.get(role) or roles[fallback]


def ordered_map(work: Callable, items: list, jobs: int = 3) -> list:
    """Results in the order of the items, at most ``jobs`` at work at once."""
    if jobs <= 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(jobs) as pool:
        return list(pool.map(work, items))


def run_stage(df: DataFrame, key: str, text: str, model: str, instructions: str, client: Client = echo_client, done: DataFrame | None = None, jobs: int = 3) -> DataFrame:
    """Outputs of a stage: (``key``, ``input_hash``, ``output``, ``error``).

    Rows that ``done`` holds under the same key and input hash are not sent
    again.  Within a partition at most ``jobs`` calls are open; a call that fails
    gives its error and no output. A null text is not sent.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("input_hash", hash_parts(F.lit(model), F.lit(instructions), F.col("text")))
    if done is not None:
        rows = rows.join(done.filter("error is null").select(F.col(key).alias("key"), "input_hash"), ["key", "input_hash"], "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(value: str) -> tuple[str | None, str | None]:
            try:
                return client(model, instructions, value), None
            except Exception as problem:  # the service's own errors are not known here
                return None, f"{type(problem).__name__}: {problem}"

        for batch in batches:
            out = ordered_map(one, batch["text"].tolist(), jobs)
            yield pd.DataFrame({"key": batch["key"], "input_hash": batch["input_hash"], "output": [o for o, _ in out], "error": [e for _, e in out]})

    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(call, f"key {kind}, input_hash string, output string, error string").withColumnRenamed("key", key)


def route_reviews(reviews: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews (``key``, ``verdict``, ``corrected``) as texts that stand and keys to adjudicate.

    A correction replaces the draft unless the verdict is to escalate.
    """
    escalated = reviews.filter("verdict = 'escalate'").select("key")
    settled = drafts.join(reviews, "key", "left").filter("verdict is null or verdict <> 'escalate'")
    texts = settled.select("key", F.when(F.length("corrected") > 0, F.col("corrected")).otherwise(F.col("text")).alias("text"), F.when(F.length("corrected") > 0, "reviewed").otherwise("draft").alias("kind"))
    return texts, escalated
