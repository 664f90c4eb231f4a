"""Dependency graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import cut_lineage


def downstream(edges: DataFrame, seeds: DataFrame, most_levels: int = 100_000) -> DataFrame:
    """All nodes reachable from ``seeds`` (``node``), themselves excluded: (``node``).

    ``edges`` has ``source`` and ``target``.  The frontier grows by one level a
    round; a node is visited once, so cycles end. Each round is written to the
    shared folder.
    """
    edges = edges.select("source", "target").distinct()
    frontier = cut_lineage(seeds.select("node").distinct())
    seen, reached = frontier, frontier.limit(0)
    for _ in range(most_levels):
        step = edges.join(frontier, edges["source"] == frontier["node"]).select(F.col("target").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        seen = seen.unionByName(frontier)
    return reached


def downstream_rows(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, node: str) -> DataFrame:
    """The rows of ``nodes`` (key ``node``) that depend on ``seeds``, in the columns of ``nodes``."""
    reached = downstream(edges, seeds).withColumnRenamed("node", node)
    return nodes.join(reached, node, "left_semi")


def graph_problems(nodes: DataFrame, edges: DataFrame, node: str, requires: str, stage: str, stages: list[str]) -> DataFrame:
    """What keeps tasks and edges from being taken in: (``code``, ``key``), one row each.

    Tasks without an id, ids used twice, stages that are none, edges of a task to
    itself, and edges one of whose ends is no task.
    """
    row = lambda df, code, key: df.select(F.lit(code).alias("code"), key.cast("string").alias("key"))
    ids = nodes.select(node).distinct()
    out = row(nodes.filter(F.coalesce(F.trim(node), F.lit("")) == ""), "task_id_missing", F.col(stage))
    out = out.unionByName(row(nodes.filter(F.length(node) > 0).groupBy(node).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "task_id_repeated", F.col(node)))
    out = out.unionByName(row(nodes.filter(~F.coalesce(F.col(stage).isin(stages), F.lit(False))), "stage_unknown", F.col(node)))
    out = out.unionByName(row(edges.filter(F.col(node) == F.col(requires)), "depends_on_itself", F.col(node)))
    for end in (node, requires):
        out = out.unionByName(row(edges.join(ids.select(F.col(node).alias(end)), end, "left_anti").select(end).distinct(), "task_unknown", F.col(end)))
    return out


def ready(nodes: DataFrame, edges: DataFrame, node: str, requires: str, done: DataFrame) -> DataFrame:
    """Nodes none of whose prerequisites is unfinished.

    ``edges`` has ``node`` and ``requires``; ``done`` has the finished ones under ``requires``.
    """
    unmet = edges.join(done, requires, "left_anti").select(node).distinct()
    return nodes.join(unmet, node, "left_anti")


def plan_graph(spark: SparkSession, chunks: DataFrame, by: str, index: str, audit: bool = True, publish: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the work on every book: stages over its chunks, in which finalizing goes chunk by chunk.

    Nodes: ``by``, ``task_id``, ``stage``; edges: ``by``, ``task_id``,
    ``depends_on``.  A book of n chunks has 4 n nodes and 4 more, and one each for
    audit and publication.
    """
    per = chunks.select(by, F.col(index).cast("string").alias("i"), F.col(index).alias("n"))
    books = chunks.select(by).distinct()
    stages = ["terms", "translate", "review", "finalize"]
    tail = ["assemble", "quality", *["audit"] * audit, *["publish"] * publish]
    single = ["metadata", "terms:consolidate", *tail]
    nodes = per.select(by, F.explode(F.array(*(F.struct(F.concat(F.lit(f"{s}:"), "i").alias("task_id"), F.lit(s).alias("stage")) for s in stages))).alias("x")).select(by, "x.*")
    nodes = nodes.unionByName(books.select(by, F.explode(F.array(*(F.struct(F.lit(s).alias("task_id"), F.lit(s.split(":")[0]).alias("stage")) for s in single))).alias("x")).select(by, "x.*"))

    def edge(a: object, b: object) -> F.Column:
        return F.struct(a.alias("task_id"), b.alias("depends_on"))

    name = lambda s: F.concat(F.lit(f"{s}:"), "i")
    first = per.select(
        by,
        F.explode(
            F.array(
                edge(name("terms"), F.lit("metadata")),
                edge(F.lit("terms:consolidate"), name("terms")),
                edge(name("translate"), F.lit("terms:consolidate")),
                edge(name("review"), name("translate")),
                edge(name("finalize"), name("review")),
                edge(F.lit("assemble"), name("finalize")),
            )
        ).alias("x"),
    ).select(by, "x.*")
    chain = per.filter("n > 1").select(by, name("finalize").alias("task_id"), F.concat(F.lit("finalize:"), (F.col("n") - 1).cast("string")).alias("depends_on"))
    ends = books.select(by, F.explode(F.array(*(edge(F.lit(b), F.lit(a)) for a, b in zip(tail, tail[1:])))).alias("x")).select(by, "x.*")
    return nodes, first.unionByName(chain).unionByName(ends)
