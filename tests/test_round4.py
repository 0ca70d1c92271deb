"""Findings F6 and F14 of the third round: merged hits by their texts, comments on functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import review, vector
from codelake.sources import reviews as sources

HIT = "g string, id long, score double, text string"


def _merged(hits, limit):
    """The first hits of each group that aren't near one that stays, one after the other."""
    out = {}
    for g in {h[0] for h in hits}:
        rows = [("permanent" if h[1] % 2 == 0 else "temporary", *h[1:]) for h in hits if h[0] == g]
        rows = [r for r in rows if r[0] == "permanent" or (r[2] is not None and r[2] >= 0.1)]
        rows.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1]))
        kept = []
        for source, i, score, text in rows:
            w = set((text or "").lower().split())
            if not any(w and v and len(w & v) >= 0.8 * len(w | v) for *_, v in kept):
                kept.append((i, source, score, w))
        out[g] = [(k + 1, *row[:3]) for k, row in enumerate(kept[:limit])]
    return out


def _hits():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    some = lambda a, b: " ".join(rng.sample(words, rng.randrange(a, b)))
    score = lambda: rng.randrange(-5, 11) / 10
    copies = [(g, i, score(), f"a b c d e f g h v{i % 4} w{i % 3}") for g in "ab" for i in range(700)]
    others = [("c", i, score(), some(1, 8)) for i in range(300)]  # many different texts, many equal scores
    crowd = [("d", i, 1 - i / 1000, f"a b c d e f g h i j k l m n o p q r s t u v x{i}") for i in range(400)] + [("d", 400 + i, 0.2, some(3, 9)) for i in range(30)]
    bare = [("e", i, rng.choice([0.5, None]), rng.choice([None, "", " \n", "\u00a0", "x y", "X  y"])) for i in range(60)]
    few = [("f", 0, 0.0, "one"), ("f", 1, 0.05, "two"), ("f", 2, None, "three"), (None, 2, 0.3, "x"), (None, 4, 0.2, "X")]
    return copies + others + crowd + bare + few


@pytest.mark.parametrize(("limit", "wide"), [(10, 8), (3, 1)])
def test_merged_texts_are_those_of_a_fold(spark, monkeypatch, limit, wide):
    monkeypatch.setattr(review, "WIDE", wide)
    hits = _hits()
    rows = spark.createDataFrame(hits, HIT).repartition(4)
    got = {}
    for r in review.search_merge(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "g", 0.1, limit, text="text").collect():
        got.setdefault(r.g, []).append((r["rank"], r.id, r.source, r.score))
    assert {g: sorted(v) for g, v in got.items()} == _merged(hits, limit)


def test_only_the_first_texts_of_a_group_meet(spark, monkeypatch):
    """What goes through the rounds grows with the groups, not with their hits."""
    given = []
    monkeypatch.setattr(review, "greedy_dedupe", lambda rows, *a, f=review.greedy_dedupe, **k: (given.append(rows.count()), f(rows, *a, **k))[1])
    hits = spark.range(6000).select((F.col("id") % 3).cast("string").alias("g"), "id", (F.col("id") % 1000 / 1000).alias("score"), F.expr("concat('v', id % 4, ' w', id % 5)").alias("text"))
    other = spark.range(6000).select(F.lit("all").alias("g"), "id", (F.col("id") / 6000).alias("score"), F.expr("concat('v', id)").alias("text"))
    both = hits.unionByName(other)
    got = review.search_merge(both.where("id % 2 = 0"), both.where("id % 2 = 1"), "g", 0.1, text="text").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"0": 10, "1": 10, "2": 10, "all": 10}
    assert len(given) == 1 and given[0] <= 3 * 20 + 80


def test_scores_by_blocks_are_those_of_pairs(spark):
    rng = random.Random(9)
    vectors = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(80)] + [None, [], [0.0] * 7, [1.0, None] + [1.0] * 5, [1.0, 2.0], [2.0, 1.0], [float("nan")] * 7]
    chunks = spark.createDataFrame([(i, f"r{i % 3}", v) for i, v in enumerate(vectors * 2)], "id long, repo_id string, embedding array<float>")
    asks = chunks.where("id % 4 < 2 and repo_id < 'r2' or id = 80").select(F.col("id").alias("query_id"), "repo_id", F.col("embedding").alias("query"))
    want = vector.scored(chunks, asks).select("query_id", "id", "score")
    for block in (2048, 7):
        assert sorted(map(str, vector.scores(chunks, asks, block).collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize(("block", "together"), [(2048, 256), (7, 3)])
def test_issues_of_functions_are_placed_without_moving_them(spark, monkeypatch, block, together):
    monkeypatch.setattr(sources, "TOGETHER", together)
    rng = random.Random(11)
    at = [None] + [dt.datetime(2024, 5, 1 + i) for i in range(6)]
    dates = {f"rev{i}": rng.choice(at) for i in range(40)}
    said = [(f"rev{rng.randrange(45)}", f"f{rng.randrange(3)}", rng.choice([None, *range(60)]), rng.choice(["high", "low", None]), rng.choice(["style", None]), f"t{i}", rng.choice(["d", None])) for i in range(400)]
    functions = [("f0", f"same{i}", "Function", 3, 20, f"s{i}") for i in range(10)] + [(f"f{i % 4}", f"n{i}", rng.choice(["Function", "Function", "Class"]), a := rng.randrange(50), a + rng.randrange(-1, 30), f"u{i}") for i in range(60)]
    reviews = spark.createDataFrame(list(dates.items()), "review_id string, completed_at timestamp").repartition(3)
    comments = spark.createDataFrame(said, "review_id string, file_path string, line_start int, severity string, category string, title string, description string").repartition(3)
    entities = spark.createDataFrame(functions, "file string, name string, type string, start_line int, end_line int, uid string")
    want = []
    for file, name, kind, start, end, _ in functions:
        own = [c for c in said if kind == "Function" and c[0] in dates and c[1] == file and c[2] is not None and start <= c[2] - 1 <= end]
        for last in (lambda c: c[5], lambda c: c[2]):
            own.sort(key=last)
        own.sort(key=lambda c: c[0], reverse=True)
        own.sort(key=lambda c: dates[c[0]] or dt.datetime(1, 1, 1), reverse=True)
        want += [(file, name, c[0], c[2], c[3], c[4], c[5], i + 1) for i, c in enumerate(own)]
    frame = sources.function_issues(reviews, comments, entities, block)
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want)) and len(want) > 1000
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not any(step in plan[: plan.index("Join")] for step in ("Window", "Exchange", "Sort "))
