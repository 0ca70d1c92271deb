"""Findings of the fourth round: the whole graph as texts, calls within a file, similar chunks."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import context, export, graph, vector
from codelake.operators.links import find_links


def _code(spark, names=60, files=9, seed=3):
    """Entities of two repositories with homonyms in several files; names are found in other words, too."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abc')}{rng.choice('xyz')}{i % 37}é" for i in range(names)]
    rows, kinds = {}, ["Function"] * 4 + ["Class", "Variable", "Import"]
    for i in range(names * 3):
        repo, file, name = f"r{i % 2}", f"f{rng.randrange(files)}.py", rng.choice(words)
        text = rng.choice([None, "", *[" ".join(rng.choice(["", "_", "no"]) + rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(9)]])
        rows[repo, file, name] = (repo, file, name, rng.choice(kinds), i, i + 1, text, f"{repo}::{file}::{name}")
    return spark.createDataFrame(list(rows.values()), "repo_id string, file string, name string, type string, start_line int, end_line int, raw_code string, uid string").repartition(3)


@pytest.mark.parametrize(("part", "share"), [(50_000, 1 << 20), (7, 1)])
def test_texts_of_a_graph_are_those_of_its_arrays(spark, monkeypatch, part, share):
    monkeypatch.setattr(graph, "PART", part)
    monkeypatch.setattr(export, "SHARE", share)
    code = _code(spark)
    imports = spark.createDataFrame([("r0", "f1.py", "f2.py"), ("r0", "f1.py", "os"), ("r1", "f2.py", "zz.py")], "repo_id string, file string, import string")
    node = lambda x: F.concat_ws("|", x["uid"], x["type"], x["start_line"], F.char_length(x["code"]), F.array_join(x["calls"], ","))
    want = context.graph_export(code, graph.link_dependencies(code), imports)
    want = want.withColumn("nodes", F.array_join(F.transform("nodes", node), ";")).withColumns({c: F.array_join(c, ",") for c in ("imports", "dependencies")})
    got = export.graph_texts(code, find_links(code), imports, F.concat_ws("|", "uid", "type", "start_line", F.char_length(F.substring("raw_code", 1, 500))))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and "::" in want.first().nodes
    if share == 1:  # large files never meet in a task
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize(("part", "within"), [(50_000, 1000), (5, 4)])
def test_calls_within_files_are_those_of_pairs(spark, monkeypatch, part, within):
    monkeypatch.setattr(graph, "PART", part)
    monkeypatch.setattr(graph, "WITHIN", within)
    odd = [("r", "f", n, c, f"u{i}") for i, (n, c) in enumerate([("", "ab cd"), (None, "b c"), ("b c", "xb cx"), ("ab", None), ("ab", "b  c"), ("é", ""), ("\n", "a\nb"), ("B", "aé"), (" ", "ab"), ("x", "b")])]
    odd += [("r", None, "a", "a", "n1"), ("r", None, "a", "a", "n2"), ("r", "f", "ab", "ab", "u3"), ("r", "f", "ab", "ab", None)]
    odd = spark.createDataFrame(odd, "repo_id string, file string, name string, code string, uid string")
    nodes = _code(spark).select("repo_id", "file", "name", F.col("raw_code").alias("code"), "uid").unionByName(odd)
    a, b = nodes.alias("a"), nodes.alias("b")
    want = a.join(b, F.expr("a.repo_id = b.repo_id and a.file = b.file and a.uid <> b.uid and contains(a.code, b.name)")).select("a.repo_id", "a.file", F.col("a.uid").alias("src_uid"), F.col("b.uid").alias("dst_uid"))
    got = graph.intra_file_calls(nodes)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and "CoGroups" in plan  # no pairs of nodes


def _vectors(spark):
    rng = random.Random(5)
    base = [[round(rng.gauss(0, 1), 3) for _ in range(6)] for _ in range(40)]
    near = [[x + rng.choice([0, 1e-6, -1e-6, 3e-7]) for x in base[i % 3]] for i in range(120)]  # scores that only rounding makes equal
    odd = [None, [], [0.0] * 6, [1.0, None] + [1.0] * 4, [1.0, 2.0], [2.0, 1.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e-170] * 6, [1e160] * 6]
    rows = [(i, f"r{i % 2}", f"f{i % 4}.py", f"n{i}", i % 9, v) for i, v in enumerate(base + near + odd * 2 + [base[0]] * 60)]
    return spark.createDataFrame(rows, "id long, repo_id string, file string, name string, start_line int, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("k", "least", "kind"), [(5, None, "double"), (3, 0.9, "double"), (5, 0.2, "float"), (1000, -2.0, "double")])
@pytest.mark.parametrize("block", [2048, 11])
def test_nearest_are_the_first_of_all_pairs(spark, k, least, kind, block):
    chunks = _vectors(spark)
    chunks = chunks.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    asks = chunks.where("id % 3 = 0 or id > 155").select(F.col("id").alias("query_id"), "repo_id", F.col("embedding").alias("query"), F.col("file").alias("of"))
    want = vector.top_k(vector.scored(chunks, asks, least), k)
    got = vector.nearest(chunks, asks, k, least, block)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []


def test_searches_make_no_row_a_pair(spark):
    chunks = _vectors(spark)
    asks = chunks.select(F.col("id").alias("query_id"), "repo_id", F.col("embedding").alias("query"))
    plan = vector.search(chunks, asks, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "zip_with" not in plan


@pytest.mark.parametrize(("near", "same"), [(0.1, 0.25), (0.9, 0.2), (-2.0, 0.99)])
def test_similar_minus_duplicates_search_once(spark, monkeypatch, near, same):
    """As two searches of all pairs give it; a copy whose line isn't known stands in both sections."""
    chunks = _vectors(spark).withColumn("start_line", F.when(F.col("id") % 7 != 0, F.col("start_line")))
    asks = chunks.where("id % 3 = 0").select(F.col("id").alias("query_id"), "repo_id", F.col("embedding").alias("query"), F.col("file").alias("query_file"), F.lit(4).alias("query_line"))
    met = vector.scored(chunks, asks, near)
    similar = vector.top_k(met, 5).where("not (file = query_file and abs(start_line - query_line) < 5)")
    copies = vector.top_k(met.where(F.col("score") >= same), 3).where("file <> query_file").join(similar.select("query_id", "file", "start_line"), ["query_id", "file", "start_line"], "left_anti")
    want = similar.select("query_id", F.lit(0).alias("section"), "id", "file", "start_line", "score").unionByName(copies.select("query_id", F.lit(1).alias("section"), "id", "file", "start_line", "score"))
    want, asked = want.collect(), []
    monkeypatch.setattr(vector, "nearest", lambda *a, f=vector.nearest: (asked.append(a), f(*a))[1])
    monkeypatch.setattr(vector, "scored", None)
    got = vector.similar_minus_duplicates(chunks, asks, near, same).select("query_id", "section", "id", "file", "start_line", "score").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.section for r in got} == {0, 1} and len(asked) == 1
