"""What reviews make of their context, reviews that are there already, nodes of graphs that aren't kept, and nearest neighbours by blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import review, vector
from codelake.sources import ingest


def test_context_usage(spark):
    texts = {1: "It DEPENDS ON this", 2: "a → b, and a Pattern", 3: "nothing of it", 4: None, 5: "the Class is similar; dependency", 6: "similar"}
    reviews = spark.createDataFrame([(i, i if i != 6 else None, t) for i, t in texts.items()], "id int, pr int, text string")
    contexts = spark.createDataFrame([(1, 2, 0, 0), (1, 1, 0, 0), (2, 1, 4, 1), (3, 5, 6, 7), (4, 1, None, 0), (7, 1, 1, 1)], "pr int, dependencies int, similar_code int, entities int")
    got = {r.id: r for r in review.context_usage(reviews, contexts, ["pr"], "text").collect()}
    assert set(got) == set(texts) and {i for i, r in got.items() if r.has_context} == {1, 2, 3, 4}
    assert [(r.mentions_dependencies, r.mentions_similar_code, r.mentions_entities) for r in (got[1], got[2], got[5], got[6])] == [(True, False, False), (True, True, False), (False,) * 3, (False,) * 3]
    assert {i: r.utilisation for i, r in got.items()} == pytest.approx({1: 100.0, 2: 200 / 3, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0})
    assert got[3].issues == ["GraphRAG has 5 dependencies but review doesn't mention them", "GraphRAG has 6 similar code patterns but review doesn't mention them"]
    assert got[1].issues == got[2].issues == got[5].issues == [] and len(got[4].issues) == 1
    assert review.context_usage(reviews.limit(0), contexts, ["pr"], "text").count() == 0


def test_existing_review(spark):
    rows = spark.createDataFrame([(1, 9, "mine: a"), (1, 4, "x mine: b"), (1, 2, "theirs"), (2, 1, None), (3, 5, "theirs")], "pr int, id int, body string")
    assert [tuple(r) for r in review.existing_review(rows, "mine:", "pr", "id", "body").collect()] == [(1, 4)]


def test_temp_nodes(spark):
    rows = [("a.py", "python", "function_definition", 3, 5, "  def f(x):  \n    pass"), ("a.py", "python", "interface_declaration", 1, 2, "x"), ("b.go", "go", "method_declaration", 0, 0, "y" * 150), ("c.py", "python", "class_definition", 0, 0, None), ("d.py", "python", "class_declaration", 7, 7, "")]
    found = spark.createDataFrame(rows, "file string, language string, node_type string, start_line int, end_line int, code string")
    got = {(r.file, r.line): (r.id, r.name, r.type) for r in ingest.temp_nodes(found).collect()}
    names = {("a.py", 3): "def f(x):", ("b.go", 0): "y" * 100, ("d.py", 7): ""}
    assert {k: v[1] for k, v in got.items()} == names
    assert all(v[0] == hashlib.md5(f"{k[0]}:{k[1]}:{names[k]}".encode()).hexdigest()[:16] for k, v in got.items())


def test_neighbours_of_blocks_and_ties(spark):
    rng = random.Random(3)
    rows = [("r" if i % 3 else "s", i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in rng.sample(range(200), 90)] + [("r", 500 + i, [1.0, 1.0, 0.0]) for i in range(40)] + [("r", 900, None), ("r", 901, [0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "repo_id string, id long, embedding array<double>")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    want = {}
    for repo, i, v in rows:
        near = sorted((-cosine(v, w), j) for r, j, w in rows if v and w and r == repo and j != i) if v else []
        want[i] = [(j, -s) for s, j in near if -s >= 0.5][:4]
    for block in (7, 64, 1024):
        got = {}
        for r in sorted(vector.neighbours(chunks, 4, 0.5, block).collect(), key=lambda r: (r.id, r["rank"])):
            got.setdefault(r.id, []).append((r.neighbour, r.score))
        assert got == {i: n for i, n in want.items() if n}


def test_search_scores(spark):
    chunks = spark.createDataFrame([(1, "r", "f", "n", 0, [3.0, 4.0]), (2, "r", "f", "n", 1, [0.0, 0.0]), (3, "r", "f", "n", 2, [4.0, -3.0])], "id long, repo_id string, file string, name string, start_line int, embedding array<float>")
    asked = spark.createDataFrame([(0, "r", [6.0, 8.0])], "query_id int, repo_id string, query array<float>")
    assert [(r.id, r.score) for r in vector.search(chunks, asked).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    assert vector.search(chunks, asked.withColumn("query", F.lit(None).cast("array<float>"))).where("score <> 0").count() == 0
