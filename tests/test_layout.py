"""The graph in buckets: same answers as from plain tables, and plans that leave the calls where they are."""

import pytest
from pyspark.sql import functions as F

from codelake.operators import graph
from codelake.sources.layout import degrees, lay_out, node, node_dependencies
from codelake.sources.store import stage

ENTITIES = "repo_id string, file string, name string, type string, start_line int, end_line int, raw_code string, uid string"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(r, f"f{i % 4}.py", f"name{i}", "Class" if i % 5 == 0 else "Function", i, i + 5, f"name{(i * 7) % 30} name{(i * 3) % 30}", f"{r}::f{i % 4}.py::name{i}") for r in ("a", "b") for i in range(30)]
    entities = spark.createDataFrame(rows, ENTITIES)
    return entities, stage(graph.link_dependencies(entities), "calls")


@pytest.fixture(scope="module")
def laid(tables):
    made = lay_out(*tables, buckets=4)
    yield made
    made.drop()


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def moved(frame):
    """The plan, and for each exchange in it that line and those below it."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines, out = plan.splitlines(), []
    depths = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "Exchange " in line:
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return plan, out


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_same_answers(tables, laid):
    entities, calls = tables
    starts = calls.groupBy("repo_id").agg(F.min("src_uid").alias("src_uid"))
    assert rows_of(graph.callers_of(entities, calls)) == rows_of(graph.callers_of(laid.entities, laid.incoming)) != []
    assert rows_of(graph.call_chains(calls, starts)) == rows_of(graph.call_chains(laid.outgoing, starts)) != []
    assert rows_of(graph.file_dependencies(entities, calls)) == rows_of(graph.file_dependencies(laid.entities, laid.outgoing)) != []
    assert rows_of(graph.unused_functions(entities, calls)) == rows_of(graph.unused_functions(laid.entities, laid.incoming))
    assert rows_of(graph.impacted_callers(entities, calls)) == rows_of(graph.impacted_callers(laid.entities, laid.incoming)) != []
    assert rows_of(laid.entities.select(entities.columns)) == rows_of(entities)


def test_degrees_and_lookups(spark, tables, laid):
    entities, calls = tables
    pairs = [(r.src_uid, r.dst_uid) for r in calls.collect()]
    got = {r.uid: (r.callees, r.callers) for r in degrees(laid).collect()}
    assert got == {r.uid: (sum(s == r.uid for s, _ in pairs), sum(d == r.uid for _, d in pairs)) for r in entities.collect()}
    uid = pairs[0][0]
    assert [r.uid for r in node(laid, uid).collect()] == [uid] and node(laid, "no such").count() == 0
    near = sorted((r.direction, r.uid) for r in node_dependencies(laid, uid).collect())
    assert near == sorted([("calls", d) for s, d in pairs if s == uid] + [("called_by", s) for s, d in pairs if d == uid])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell what it prunes
    try:
        assert "SelectedBucketsCount: 1 out of 4" in node(laid, uid)._jdf.queryExecution().executedPlan().toString()
        assert node_dependencies(laid, uid)._jdf.queryExecution().executedPlan().toString().count("SelectedBucketsCount: 1 out of 4") == 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_calls_stay_where_they_are(spark, tables, laid, no_broadcast):
    plan, exchanges = moved(degrees(laid))
    assert plan.count("FileScan") == 3 and not exchanges
    # Only functions that nothing calls move, for the limit of a repository; of the chains only the trails.
    plan, _ = moved(graph.unused_functions(laid.entities, laid.incoming, None))
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    starts = spark.createDataFrame([("a", "a::f0.py::name4")], "repo_id string, src_uid string")
    plan, exchanges = moved(graph.call_chains(laid.outgoing, starts, depth=1))
    assert "SortMergeJoin" in plan
    below = [x for x in exchanges if "SortMergeJoin" not in x]  # what moves before the join
    assert len(below) == 1 and "graph_outgoing" not in below[0] and "graph_outgoing" in plan


def test_empty_and_unknown(spark, tables):
    entities, calls = tables
    none = lay_out(entities.limit(0), calls.limit(0))
    assert degrees(none).count() == none.incoming.count() == 0
    none.drop()
    odd = spark.createDataFrame([("a", "a::f0.py::name0", "nobody"), ("a", None, "a::f0.py::name0")], "repo_id string, src_uid string, dst_uid string")
    made = lay_out(entities, odd)
    assert made.outgoing.count() == 0 and degrees(made).where("callees + callers > 0").count() == 0
    made.drop()
    assert not spark.catalog.tableExists(made.names[0])


def test_relationships(spark, tables):
    entities, calls = tables
    imports = spark.createDataFrame([("a", "f0.py", "f1.py")], "repo_id string, file string, depends_on string")
    got = {(r.repo_id, r.relationship): r.relationships for r in graph.relationship_census(entities, calls, imports).collect()}
    assert got == {(r, "CONTAINS"): 30 for r in "ab"} | {(r, "CALLS"): calls.where(F.col("repo_id") == r).count() for r in "ab"} | {("a", "IMPORTS"): 1}
