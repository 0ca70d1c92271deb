"""Findings of the third round: texts of numbers, memory of parsers and patches, calls told by mentions."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelake.operators import context, diff, trees


def test_two_places_are_those_of_printf(spark):
    rng = random.Random(3)
    values = [0.285, 0.125, 0.375, 0.575, 1.005, -0.001, 0.0, -0.0, 0.29, 0.995, 1.0, 12345.675, -0.125] + [k / 1000 for k in range(-1000, 1001)] + [rng.uniform(-1, 1) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", context.two_places(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{v:.2f}" for v in values]


def test_similar_snippets_round_as_the_sql_does(spark):
    hits = spark.createDataFrame([(1, 1, "a.py", 3, 0.285, "x", "r"), (1, 2, "a.py", 4, 0.125, "y", "r")], "query_id long, rank int, file string, start_line int, score double, snippet string, reason string")
    text = context.similar_snippets(hits).collect()[0].text
    assert re.findall(r"similarity: ([\d.]+)", text) == ["0.28", "0.12"]


def test_nodes_leave_a_batch_in_parts():
    """What a task holds doesn't grow with the nodes of a batch of texts."""
    text = "\n".join("if a and b or c: x = 1" for _ in range(300))
    batch = pa.RecordBatch.from_pydict({"k": list(range(40)), "t": [text] * 40, "l": ["python"] * 40})
    parts = list(trees._node_batches(batch, "k", dict(trees._TREES)))
    one = len(trees.python_nodes(text))
    assert sum(p.num_rows for p in parts) == 40 * one and max(p.num_rows for p in parts) < trees.TOGETHER + one
    assert len(parts) > 3


def _numbered(patch):
    """The lines of a patch with their numbers, one after the other."""
    out, hunk, old, new = [], 0, None, None
    for pos, line in enumerate(patch.split("\n")):
        if line.startswith("@@"):
            hunk += 1
            m = re.match(diff.HUNK, line)
            old, new = (int(m[1]), int(m[2])) if m else (None, None)
            out.append((pos, line, hunk, "header", old, new))
            continue
        kind = "add" if line.startswith("+") and not line.startswith("+++") else "delete" if line.startswith("-") and not line.startswith("---") else "context" if line.startswith(" ") else "other"
        out.append((pos, line, hunk, kind, old, new))
        old = None if old is None else old + (kind in ("delete", "context"))
        new = None if new is None else new + (kind in ("add", "context"))
    return out


def test_lines_are_numbered_without_sorting_them(spark, monkeypatch):
    rng = random.Random(4)
    lines = ["+a", "-b", " c", "", "+++ x", "--- y", "@@ -3,4 +7,2 @@ f", "@@ -1 +9 @@", "@@ broken", "\\ No newline"]
    patches = {k: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40))) for k in range(60)} | {60: "", 61: None, 62: "@@ -1 +99999999999 @@\n a"}
    rows = spark.createDataFrame(list(patches.items()), "pr long, patch string")
    frame = diff.numbered_rows(rows, "pr")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan
    got = {}
    for r in frame.collect():
        got.setdefault(r.pr, []).append(tuple(r)[1:])
    want = {k: _numbered(p) for k, p in patches.items() if p is not None}
    want[62] = [(0, "@@ -1 +99999999999 @@", 1, "header", 1, None), (1, " a", 1, "context", 1, None)]
    assert got == want


def test_patches_are_cut_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(diff, "LINES", 10)
    batch = pa.RecordBatch.from_pydict({"pr": [1, 2], "patch": ["\n".join("+x" for _ in range(25)), None]})
    parts = list(diff._numbered(batch))
    assert [p.num_rows for p in parts] == [10, 10, 5] and [v for p in parts for v in p.column("pos").to_pylist()] == list(range(25))


def test_hunks_are_cut_where_they_stand(spark):
    patches = {1: "index\n@@ -1 +1 @@\n a\n@@@\n", 2: "@@ -1 +1 @@", 3: "none", 4: None, 5: "@@ x\n\n+@@\n@@ y\n"}
    frame = diff.patch_hunks(spark.createDataFrame(list(patches.items()), "pr long, patch string"), "pr")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    want = [(1, 1, 2, "@@ -1 +1 @@\n a"), (1, 2, 2, "@@@\n"), (2, 1, 1, "@@ -1 +1 @@"), (5, 1, 3, "@@ x\n\n+@@"), (5, 2, 2, "@@ y\n")]
    assert sorted(map(tuple, frame.collect())) == want


@pytest.fixture(scope="module")
def linked(spark):
    """Entities with homonyms, within a file too far apart to be called and in many files, and their links; all calls beside them."""
    from codelake.operators import graph
    from codelake.operators.links import find_links
    from codelake.sources.store import stage

    rng = random.Random(8)
    rows = {}
    for i in range(260):
        repo, file, name = f"r{i % 2}", f"f{rng.randrange(9)}.py", f"word{rng.randrange(25)}x" if i % 9 else "abc"
        rows[f"{repo}::{file}::{name}"] = (repo, file, name, rng.choice(["Function", "Function", "Class", "Module"]), rng.randrange(300), 400, " ".join(f"word{rng.randrange(30)}x" for _ in range(rng.randrange(12))), f"{repo}::{file}::{name}")
    entities = spark.createDataFrame(list(rows.values()), "repo_id string, file string, name string, type string, start_line int, end_line int, raw_code string, uid string")
    return entities, stage(graph.link_dependencies(entities), "calls"), find_links(entities)


@pytest.mark.parametrize("parts", [50_000, 4])
def test_links_answer_as_calls_do(spark, linked, monkeypatch, parts):
    from codelake.operators import graph
    from codelake.operators.links import find_links

    entities, calls, links = linked
    monkeypatch.setattr(graph, "PART", parts)  # a function's names may lie in several parts
    links = links if parts == 50_000 else find_links(entities)
    keys = entities.select("repo_id", F.col("uid").alias("src_uid"))
    changed = entities.select(F.lit(1).alias("pr"), "repo_id", "file").where("file < 'f4'").distinct()
    starts = calls.groupBy("repo_id").agg(F.min("src_uid").alias("src_uid"))
    asks = {
        "calls": lambda c: c if c is calls else c.calls,
        "callees": lambda c: graph.callees_near_line(entities, c, 100),
        "many callees": lambda c: graph.callees_near_line(entities, c, 100, per_source=30),
        "callers": lambda c: graph.callers_of(entities, c),
        "chains": lambda c: graph.call_chains(c, starts),
        "files": lambda c: graph.file_dependencies(entities, c),
        "fanout": lambda c: graph.fanout(c),
        "fanin": lambda c: graph.fanin(c),
        "names": lambda c: graph.calls_by_name(entities, c),
        "unused": lambda c: graph.unused_functions(entities, c),
        "impacted": lambda c: graph.impacted_callers(entities, c),
        "census": lambda c: graph.relationship_census(entities, c, changed.withColumn("depends_on", F.lit("x"))),
        "summary": lambda c: context.dependencies_summary(entities, c),
        "prompt": lambda c: context.compressed_dependencies(entities, c, keys=keys),
        "tree": lambda c: context.entity_tree(entities, c),
        "related": lambda c: context.related_code(entities, c),
        "impact": lambda c: context.pr_impact(changed, entities, c),
    }
    for name, ask in asks.items():
        got, want = ask(links), ask(calls)
        assert sorted(map(str, got.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect())), name


def test_chains_leave_a_repository_that_is_full(spark):
    """Each level leaves at most `limit` trails of a repository, and calls never go whole to every task."""
    from codelake.operators import graph

    calls = spark.createDataFrame([("r", f"u{i}", f"u{j}") for i in range(40) for j in range(40) if i != j] + [("s", "a", "b"), ("s", "b", "c"), ("s", "b", "a")], "repo_id string, src_uid string, dst_uid string")
    starts = calls.groupBy("repo_id").agg(F.min("src_uid").alias("src_uid"))
    frame = graph.call_chains(calls, starts)
    got = sorted((r.repo_id, r.depth, r.path) for r in frame.collect())
    assert got == sorted([("r", 1, f"u0 > {u}") for u in sorted(f"u{j}" for j in range(1, 40))[:10]] + [("s", 1, "a > b"), ("s", 2, "a > b > a"), ("s", 2, "a > b > c")])
    # The first level of `r` is full, so none of its 39 * 39 * 39 trails is made.
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1


def test_links_in_buckets_answer_alike(spark, linked):
    from codelake.operators import graph
    from codelake.sources.layout import degrees, lay_out, lay_out_links

    entities, calls, links = linked
    laid, whole = lay_out_links(links, buckets=4), lay_out(entities, calls, buckets=4)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) != []
    starts = calls.groupBy("repo_id").agg(F.min("src_uid").alias("src_uid"))
    assert same(degrees(laid), degrees(whole))
    assert same(graph.callers_of(laid.entities, laid), graph.callers_of(entities, calls))
    assert same(graph.file_dependencies(laid.entities, laid), graph.file_dependencies(entities, calls))
    assert same(graph.unused_functions(laid.entities, laid, None), graph.unused_functions(entities, calls, None))
    assert same(graph.call_chains(laid, starts), graph.call_chains(calls, starts))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # neither what functions say nor mentions move to be counted or ranked
        for frame in (laid.fanout(), laid.callers_by_name(10), laid.mentioned.groupBy("repo_id", "src_file", "name").count()):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole.drop()
