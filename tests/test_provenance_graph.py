import hashlib

import pytest
from pyspark.sql import functions as F

from inkloom.operators import graph, provenance, records


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_drift_accepts_both_hashes(spark):
    rows = [(1, "a", sha("a")), (2, "a", sha("a\0")), (3, "a", sha("b")), (4, "a", None), (5, None, sha("a"))]
    got = provenance.drift(spark.createDataFrame(rows, "k long, t string, h string"), "t", "h").collect()
    assert {r["k"]: r["state"] for r in got} == {3: "changed", 4: "unrecorded", 5: "no_text"}


def test_work_left(spark):
    inputs = spark.createDataFrame([(1, "x"), (2, "y")], "k long, h string")
    done = spark.createDataFrame([(1, "x"), (2, "z")], "k long, h string")
    assert [r["k"] for r in provenance.work_left(inputs, done, ["k"], "h").collect()] == [2]


def test_invalidation(spark):
    changed = spark.createDataFrame([(1, "prompts"), (1, "models"), (2, None), (3, "weather"), (4, "source")], "b long, dependency string")
    plan = provenance.invalidation(spark, changed, ["b"])
    stale = {b: [r["stage"] for r in plan.filter(f"stale and b = {b}").orderBy("stage_no").collect()] for b in (1, 2, 3, 4)}
    assert stale[1] == ["terms", "draft", "review", "finalize", "qa", "assemble", "publish"] and stale[2] == stale[3] == []
    assert stale[4][0] == "extract" and plan.count() == 40
    done = spark.createDataFrame([(1, "chunk", "succeeded"), (1, "terms", "succeeded"), (2, "terms", "ready")], "b long, stage string, status string")
    assert sorted((r["b"], r["stage"], r["status"]) for r in provenance.mark_stale(done, plan, ["b"]).collect()) == [(1, "chunk", "succeeded"), (1, "terms", "stale"), (2, "terms", "ready")]


def test_drift_refuses_to_resume(spark):
    then = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, h string")
    now = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, h string")
    with pytest.raises(ValueError, match="changed"):
        provenance.refuse_drift(then, now, "path", "h")
    assert sorted((r["path"], r["found"]) for r in provenance.refuse_drift(then, now, "path", "h", allow=True).collect()) == [("b", "9"), ("c", None)]
    assert provenance.refuse_drift(then, then, "path", "h").count() == 0


def test_records(spark):
    rows = [(1, "- Source edition: Harbour Press, copyright 1987; ISBN `978-1-4`; cloth\n- Book: **Tides**\n- Genre: TODO ask", "Completed chunks: 12\nCompleted on: 2026-02-03\n- Status: complete", "# 一\n\nx\n\n# 二十\n\n# Two", "h", "zh"), (2, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "b long, brief string, progress string, book string, h string, l string")
    got = {r["b"]: r for r in records.book_metadata(df, "b", "brief", "progress", "book", "h", "l").collect()}
    assert (got[1]["publication_year"], got[1]["isbn"], got[1]["chunk_count"], str(got[1]["completed_at"]), got[1]["complete"], got[1]["chapter_count"]) == (1987, "978-1-4", 12, "2026-02-03", True, 2)
    assert (got[2]["publication_year"], got[2]["isbn"], got[2]["chunk_count"], got[2]["complete"]) == (None, None, None, False)
    seen = df.filter("b = 1").select(records.field(F.col("brief"), "Book"), records.field(F.col("brief"), "Genre", F.lit("Fantasy")), records.field(F.col("brief"), "None"), records.property_text(F.lit("x" * 3000))).first()
    assert seen[:3] == ("Tides", "Fantasy", None) and len(seen[3]) == 2000
    assert records.overlay({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}, "c": 2}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}, "c": 2}
    assert records.missing_columns(df, ["h", "z", "a"]) == ["a", "z"]
    known = spark.createDataFrame([("k1", "One", 11), (None, "Two", 12), (None, "Six", 13), (None, "Six", 14)], "k string, t string, page long")
    wanted = spark.createDataFrame([("k1", "Other"), ("k2", "Two"), ("k3", "New")], "k string, t string")
    assert {r["k"]: r["page"] for r in records.resolve_or_title(wanted, known, "k", "t", "page").collect()} == {"k1": 11, "k2": 12, "k3": None}
    with pytest.raises(ValueError, match="more than one"):
        records.resolve_or_title(spark.createDataFrame([("k9", "Six")], "k string, t string"), known, "k", "t", "page")
    assert records.reviews_with_issues(spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "c long, issues array<string>"), "issues").count() == 1


def test_map_changes(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4", "a": "1"})], "x map<string,string>, y map<string,string>")
    assert df.select(provenance.map_changes(F.col("x"), F.col("y"))).first()[0] == ["b", "c"]


def test_closure_with_cycle_and_depth(spark):
    edges = [(str(i), str(i + 1)) for i in range(12)] + [("12", "3"), ("x", "y")]
    got = graph.downstream(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("0",)], "node string"))
    assert sorted(r["node"] for r in got.collect()) == sorted(str(i) for i in range(1, 13))
    assert graph.downstream(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("q",)], "node string")).count() == 0


def test_plan_of_two_chunks(spark):
    chunks = spark.createDataFrame([(1, 1), (1, 2)], "b long, i int")
    nodes, edges = graph.plan_graph(spark, chunks, "b", "i")
    assert nodes.count() == 14
    assert {r["depends_on"] for r in edges.filter("task_id = 'finalize:2'").collect()} == {"review:2", "finalize:1"}
    done = spark.createDataFrame([], "depends_on string")
    ready = graph.ready(nodes, edges, "task_id", "depends_on", done)
    assert [r["task_id"] for r in ready.collect()] == ["metadata"]
    after = graph.ready(nodes, edges, "task_id", "depends_on", spark.createDataFrame([("metadata",)], "depends_on string"))
    assert sorted(r["task_id"] for r in after.collect()) == ["metadata", "terms:1", "terms:2"]


def test_graph_problems_and_dependent_rows(spark):
    nodes = spark.createDataFrame([("a", "terms"), ("b", "qa"), ("b", "qa"), ("c", "cook"), ("", "qa"), (None, "terms")], "task string, stage string")
    edges = spark.createDataFrame([("b", "a"), ("c", "c"), ("c", "x"), ("y", "a")], "task string, needs string")
    got = sorted((r["code"], r["key"]) for r in graph.graph_problems(nodes, edges, "task", "needs", "stage", ["terms", "qa"]).collect())
    assert got == [("depends_on_itself", "c"), ("stage_unknown", "c"), ("task_id_missing", "qa"), ("task_id_missing", "terms"), ("task_id_repeated", "b"), ("task_unknown", "x"), ("task_unknown", "y")]
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    rows = graph.downstream_rows(nodes, links, spark.createDataFrame([("a",)], "node string"), "task")
    assert rows.columns == ["task", "stage"] and sorted(r["task"] for r in rows.collect()) == ["b", "b", "c"]
