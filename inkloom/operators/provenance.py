"""Content hashes against recorded ones, incremental work, invalidation of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.hashing import hash_parts, hash_text

# Stages in order, and the first stage that a dependency reaches.
STAGES = "metadata extract chunk terms draft review finalize qa assemble publish".split()
DEPENDENCIES = {"source": "extract", "config": "metadata", "prompts": "terms", "references": "terms", "models": "terms"}


def drift(df: DataFrame, text: str, recorded: str) -> DataFrame:
    """Rows whose recorded hash is missing or is neither form of their text's hash; ``state`` tells which."""
    own = F.col(text)
    accepted = (F.col(recorded) == hash_text(own)) | (F.col(recorded) == hash_parts(own))
    state = F.when(own.isNull(), "no_text").when(F.col(recorded).isNull(), "unrecorded").when(accepted, "same").otherwise("changed")
    return df.withColumn("state", state).filter("state <> 'same'")


def work_left(inputs: DataFrame, done: DataFrame, keys: list[str], input_hash: str) -> DataFrame:
    """Inputs that no finished row has under the same hash."""
    return inputs.join(done.select(*keys, input_hash).distinct(), [*keys, input_hash], "left_anti")


def stage_input(*parts: Column) -> Column:
    """The cache key of a stage: one hash over model, instructions and input."""
    return hash_parts(*parts)


def invalidation(spark: SparkSession, changed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, ``stage_no``, ``stage``, ``stale``) for changed dependencies (``by``, ``dependency``): all from the earliest stage they reach on.

    Dependencies that no stage knows change nothing; without ``by`` there is one plan.
    """
    by = by or []
    stages = spark.createDataFrame(list(enumerate(STAGES, 1)), "stage_no int, stage string")
    reach = spark.createDataFrame(list(DEPENDENCIES.items()), "dependency string, stage string")
    first = changed.join(F.broadcast(reach), "dependency", "left").join(F.broadcast(stages), "stage", "left").groupBy(*by).agg(F.min("stage_no").alias("first"))
    # Ten stages: a fixed size.
    each = first.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES, 1)))))
    return each.select(*by, "s.stage_no", "s.stage", F.coalesce(F.col("s.stage_no") >= F.col("first"), F.lit(False)).alias("stale"))


def mark_stale(artifacts: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Artifacts (``by``, ``stage``, ``status``) with those of stale stages marked; nothing is changed in place."""
    stale = plan.filter("stale").select(*by, "stage", F.lit(True).alias("_stale")).distinct()
    return artifacts.join(stale, [*by, "stage"], "left").withColumn("status", F.when(F.col("_stale"), "stale").otherwise(F.col("status"))).drop("_stale")


def refuse_drift(recorded: DataFrame, found: DataFrame, key: str, value: str, allow: bool = False) -> DataFrame:
    """Inputs whose recorded fingerprint is no longer there: (``key``, ``recorded``, ``found``); raises unless they are allowed."""
    r, f = recorded.select(key, F.col(value).alias("recorded")), found.select(key, F.col(value).alias("found"))
    moved = r.join(f, key, "left").filter(~F.col("recorded").eqNullSafe(F.col("found")))
    if not allow and (first := moved.limit(3).collect()):
        raise ValueError("inputs changed since the run began: " + ", ".join(str(x[key]) for x in first))
    return moved


def map_changes(before: Column, after: Column) -> Column:
    """Keys whose value differs between two maps, sorted."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(before, k).eqNullSafe(F.element_at(after, k))))
