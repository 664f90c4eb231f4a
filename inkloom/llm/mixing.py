"""Mixing sources to target weights.

Poisson replication: a hash of mix and document is a fixed uniform number; a
document comes as often as the Poisson distribution of the source's mean rate,
inverted at that number, says. Copies are exploded and shuffled globally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import broadcast_if_small, cut_lineage

#: Rates are told apart in this many steps a source; the last step is split by document.
STEPS = 4096


def _thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document its copies 1..cap, each with the least mean rate at which the inverted Poisson distribution grants it."""
    for batch in batches:
        parts = []
        for k in range(1, int(batch["cap"].max() or 0) + 1 if len(batch) else 1):
            own = batch[batch["cap"] >= k]
            parts.append(own.drop(columns="u").assign(copy_no=k, rate=rate_for(k, own["u"].to_numpy())))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def rate_for(k: int, u: np.ndarray) -> np.ndarray:
    """The rates at which a Poisson variable is below ``k`` with probability ``u``, by bisection.

    The k-th copy is granted when P(N < k) <= u, so from this rate on.
    """
    if k == 1:
        return -np.log(u)
    low, high = np.zeros(len(u)), np.full(len(u), 4.0 * k + 60.0)
    for _ in range(44):
        mid = (low + high) / 2
        term = np.exp(-mid)
        total = term.copy()
        for i in range(1, k):
            term = term * mid / i
            total += term
        above = total > u
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return high


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The drawn copies of every mix, in a global random order.

    ``sizes`` has ``doc_id``, ``source`` and ``tokens``, one row per document;
    ``targets`` has ``mix_name``, ``source``, ``target_share``, ``max_repeats``
    and ``size_ratio``.  A source is to give ``target_share * size_ratio * all
    tokens``, documents without a source counting among all.

    Columns: ``mix_name``, ``source``, ``doc_id``, ``copy_no``, ``repeats``,
    ``tokens``, ``position`` (a random 64-bit number; the rows are sorted by it).

    The mean rate of a source is the one at which its granted copies add up to
    its target; with ``max_repeats`` in force, that is more than target by size.
    It is read off the sums of tokens by rate, so the noise of the draw does not
    move the share.  Rates are told apart in ``STEPS`` steps a source, and within
    the step in which the target is reached copies are granted by a hash; the
    share is met but for the noise of that one step, about the size of a document
    for small sources and less than a thousandth for large ones. Where even ``max_repeats`` copies of every document do not
    reach the target, all are drawn. Documents without a source, null or negative
    shares, sources without documents and documents without tokens draw nothing;
    a null ``max_repeats`` counts as 1. A target named twice in a mix counts once,
    with the sum of its shares and the larger cap. Draws depend on ``seed`` and ids
    only.
    """
    sizes = cut_lineage(sizes.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")))  # three numbers a document, read several times
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    wanted = (
        targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"), F.max("size_ratio").alias("ratio"))
        .crossJoin(F.broadcast(total))  # one row
        .select("mix_name", "source", F.col("cap").cast("int").alias("cap"), (F.col("share") * F.col("ratio") * F.col("all_tokens")).alias("target"))
    )
    docs = sizes.filter(F.col("source").isNotNull() & (F.col("tokens") > 0)).select("doc_id", "source", "tokens")
    # The table of targets is broadcast if small; a source that holds a third of the rows is not moved for it.
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"))
    wanted = broadcast_if_small(wanted.join(have, "source").filter("target > 0 and cap > 0"))
    drawn = docs.join(wanted, "source")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "source", "doc_id"), 11)
    drawn = drawn.withColumn("u", (bits + F.lit(0.5)) / F.lit(float(1 << 53)))
    copies = drawn.select("mix_name", "source", "doc_id", "tokens", "cap", "u").mapInPandas(_thresholds, "mix_name string, source string, doc_id long, tokens long, cap int, copy_no int, rate double")
    # Rates on a fixed grid: at most STEPS sums for each source and mix. Worked out once, and read for the sums and for the draw.
    copies = copies.withColumn("step", F.floor(F.lit(float(STEPS)) * F.col("rate") / (F.col("rate") + F.col("cap"))).cast("int"))
    copies = cut_lineage(copies.select("mix_name", "source", "doc_id", "tokens", "copy_no", "step"))
    sums = copies.groupBy("mix_name", "source", "step").agg(F.sum("tokens").alias("added"))
    upto = Window.partitionBy("mix_name", "source").orderBy("step")
    sums = sums.withColumn("after", F.sum("added").over(upto)).join(wanted.select("mix_name", "source", "target"), ["mix_name", "source"])
    # One row for each source of a mix whose target is reached: the step where, and the share of that step.
    cuts = sums.filter("after >= target and after - added < target").select(
        "mix_name", "source", F.col("step").alias("last_step"), ((F.col("target") - F.col("after") + F.col("added")) / F.col("added")).alias("part")
    )
    fine = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy_no"), 11) / F.lit(float(1 << 53))
    granted = copies.join(broadcast_if_small(cuts), ["mix_name", "source"], "left").filter(
        F.col("last_step").isNull() | (F.col("step") < F.col("last_step")) | ((F.col("step") == F.col("last_step")) & (fine < F.col("part")))
    )
    each = granted.groupBy("mix_name", "source", "doc_id", "tokens").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    exploded = each.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    exploded = exploded.withColumn("position", F.xxhash64(F.lit(seed + 2), "mix_name", "doc_id", "copy_no"))
    return exploded.select("mix_name", "source", "doc_id", "copy_no", "repeats", "tokens", "position").orderBy("position")


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of each mix: what was wanted and what came.

    Columns: ``mix_name``, ``source``, ``target_share``, ``documents``,
    ``copies``, ``tokens``, ``most_repeats`` and ``actual_share`` of the mix's
    tokens.  Sources that gave nothing have zeros.
    """
    by = drawn.groupBy("mix_name", "source").agg(
        F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    wanted = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    rows = wanted.join(by, ["mix_name", "source"], "left").fillna(0, ["documents", "copies", "tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6))
