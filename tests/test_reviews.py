"""Review sinks and history, and complexity over syntax trees."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelake.operators import trees
from codelake.sources.reviews import COMMENT, REVIEW, ReviewStore

AT = dt.datetime(2024, 5, 1, 12)


def review(i, pr="p1", hours=0, status="completed"):
    summary = (85, 3, 2, 1, 0, 1, 0, 0)
    return (f"rev{i}", pr, status, summary, ["change"], ["advice"], [], "model", 1000, 500, 0.05, 3000, AT, AT + dt.timedelta(hours=hours))


def comment(i, file, line, severity="high", category="security", title="t"):
    return (f"rev{i}", file, line, None, severity, category, title, "text", None, "code")


def rows(frame):
    return sorted(frame.collect(), key=str)


def test_reviews_round_trip_and_replays(spark, tmp_path):
    store = ReviewStore(spark, f"file://{tmp_path}/reviews", buckets=4)
    reviews = spark.createDataFrame([review(1), review(2, hours=2), review(3, "p2", 1)], REVIEW)
    comments = spark.createDataFrame([comment(1, "a.py", 3), comment(1, "a.py", 9, "critical", "style"), comment(2, "a.py", 3, "low"), comment(3, "b.py", 1, "medium"), comment(9, "zz.py", 1)], COMMENT)
    assert store.save("r", reviews, comments) == {"reviews": 3, "review_comments": 4, "reviewed_file": 3}
    first = {t: rows(store.store.read(t, "r")) for t in store.store.tables}
    assert [tuple(r)[:-1] for r in first["reviews"]] == sorted(map(tuple, reviews.collect()), key=str)
    store.save("r", reviews, comments)  # the same once more
    assert {t: rows(store.store.read(t, "r")) for t in store.store.tables} == first
    edge = {(r.review_id, r.file_path): (r.issues_found, r.severity_max, r.categories) for r in first["reviewed_file"]}
    assert edge["rev1", "a.py"] == (2, "critical", ["security", "style"])
    assert [(r.pull_request_id, r.place, r.review_id) for r in store.history("r").orderBy("pull_request_id", "place").collect()] == [("p1", 1, "rev2"), ("p1", 2, "rev1"), ("p2", 1, "rev3")]
    assert [(r.file_path, r.place, r.review_id) for r in store.file_history("r", 1).orderBy("file_path").collect()] == [("a.py", 1, "rev2"), ("b.py", 1, "rev3")]
    functions = spark.createDataFrame([("r", "a.py", "outer", "Function", 0, 9, "u1"), ("r", "a.py", "inner", "Function", 2, 2, "u2"), ("r", "a.py", "Kind", "Class", 0, 9, "u3"), ("q", "a.py", "x", "Function", 0, 9, "u4")], "repo_id string, file string, name string, type string, start_line int, end_line int, uid string")
    assert [(r.function, r.place, r.review_id, r.line) for r in store.function_issues("r", functions).orderBy("function", "place").collect()] == [("inner", 1, "rev2", 3), ("inner", 2, "rev1", 3), ("outer", 1, "rev2", 3), ("outer", 2, "rev1", 3), ("outer", 3, "rev1", 9)]
    # A review that is saved again loses the comments that it no longer has.
    store.save("r", reviews.where("review_id = 'rev1'").withColumn("status", F.lit("edited")), comments.limit(0))
    assert {(r.review_id, r.status) for r in store.store.read("reviews", "r").collect()} == {("rev1", "edited"), ("rev2", "completed"), ("rev3", "completed")}
    assert {r.review_id for r in store.store.read("review_comments", "r").collect()} == {"rev2", "rev3"} == {r.review_id for r in store.store.read("reviewed_file", "r").collect()}


def test_a_stream_of_reviews(spark, tmp_path):
    store = ReviewStore(spark, f"file://{tmp_path}/reviews", buckets=4)
    batch = spark.createDataFrame([(*review(i, f"p{i % 2}"), f"repo{i % 2}", [comment(i, "a.py", i)] * i) for i in range(1, 5)], f"{REVIEW}, repo_id string, comments array<struct<{COMMENT.replace(' ', ':').replace(',:', ',')}>>")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a stream that lost its checkpoint sends everything once more
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(store.sink).option("checkpointLocation", f"{tmp_path}/c{_}").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
        assert {(r.repo_id, r.review_id): r["count"] for r in store.store.read("review_comments").groupBy("repo_id", "review_id").count().collect()} == {(f"repo{i % 2}", f"rev{i}"): i for i in range(1, 5)}


CODE = """
def outer(a, b, c):
    if a and b or c:
        return 1
    elif a:
        x = 1 if b else 2
    elif b:
        pass
    else:
        for i in range(3):
            while i or a and b and c:
                break
        else:
            pass
    try:
        def inner():
            return [i for i in a if i]
    except (ValueError, KeyError):
        return a + b
    else:
        pass
    return a and b and c


class Empty:
    pass
"""
# if, two boolean operators; elif, conditional; elif; else; for, its else; while, three operators; except, the try's else; two operators
OUTER = 3 + 2 + 1 + 1 + 2 + 4 + 2 + 2


def test_complexity_of_trees(spark):
    texts = spark.createDataFrame([(1, CODE, "python"), (2, "def f(:", "Python"), (3, "if (a && b) {}", "go"), (4, None, "python"), (5, "", "python"), (6, CODE, None)], "id int, text string, language string")
    got = {r.id: (r.complexity, r.by) for r in trees.complexity(texts, "id", "text", "language").collect()}
    assert got[1] == (1 + OUTER, "tree") and got[5] == (1, "tree") and got[4] == (1, "text") and got[3] == (3, "text") and got[2][1] == got[6][1] == "text"
    nodes = trees.syntax_nodes(texts, "id", "text", "language")
    assert [(r.id, r.first_line, r.complexity) for r in trees.definition_complexity(nodes, "id").orderBy("begin").collect()] == [(1, 1, 1 + OUTER), (1, 15, 1)]
    spans = {(r.begin, r.last) for r in nodes.where("id = 1").collect()}
    assert (0, len(spans) - 1) in spans  # the root holds all
    for a in spans:  # intervals nest
        assert all(b[1] <= a[1] for b in spans if a[0] < b[0] <= a[1])


@pytest.mark.parametrize("kind", trees.DECISIONS)
def test_each_kind_of_decision_counts(spark, kind):
    nodes = spark.createDataFrame([(1, "module", 0, 1, None), (1, kind, 1, 1, "a * b")], "id int, type string, begin int, last int, text string")
    assert trees.tree_complexity(nodes, "id").first().complexity == 2


def test_binary_expressions_that_look_logical_count_twice(spark):
    texts = ["a && b", "a || b", "a and b", "a + for_x", "brand * 2", "a + b", None]
    nodes = spark.createDataFrame([(i, "binary_expression", 0, 0, t) for i, t in enumerate(texts)] + [(0, "identifier", 1, 1, "or")], "id int, type string, begin int, last int, text string")
    assert [r.complexity for r in trees.tree_complexity(nodes, "id").orderBy("id").collect()] == [3, 3, 3, 3, 3, 2, 2]
