"""Language-model scores, the quality classifier, nearest neighbours."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelake.llm import common
from codelake.llm.ann import IndexConfig, ann_search, cell_runs, passed_products, walk
from codelake.llm.classifier import FtrlConfig, _Words, features, score, train, training_rows
from codelake.llm.common import WordHashes, from_packed_planes, pack_keys, packed_planes, shard_ends, unpack_keys
from codelake.llm.lm_scoring import Model, bucket_of, counted_blocks, expectation, interpolated, learn, lm_scores
from codelake.llm.queries import fold


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def test_lm_base_scores(hard, hard_rows, nothing):
    got = lm_scores(hard, fold(F.col("doc_id"), 10)).collect()
    folds = [zlib.crc32(str(r[0]).encode()) % 10 if r[0] is not None else -1 for r in hard_rows]
    count = Counter(t for r, f in zip(hard_rows, folds, strict=True) if f for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], f == 0, len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), 5)) for r, f in zip(hard_rows, folds, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_scores(nothing, fold(F.col("doc_id"), 10)).count() == 0


def test_lm_probabilities_add_up_and_beat_the_base(spark):
    rng = random.Random(5)
    follow = {w: rng.sample("abcdefghij", 3) for w in "abcdefghij"}
    rows = []
    for i in range(400):
        w, out = rng.choice("abcdefghij"), []
        for _ in range(30):
            out.append(w)
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scores(docs, fold(F.col("doc_id"), 10)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    model = learn(counted_blocks(docs, fold(F.col("doc_id"), 10), "doc_id", "text"))
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(t for s in train for t in s), Counter(p for s in train for p in zip([None, *s], s, strict=False))
    for h in (None, "a", "unseen"):
        words = [*one, "unknown"]
        p = interpolated(model, np.array([two[h, w] for w in words]), np.full(len(words), one[h]), np.array([one[w] for w in words]))
        assert p.sum() == pytest.approx(1)


def naive_weights(docs):
    """The mixture by the book, event by event: (weights by bucket, counts of tokens, counts of pairs) of (fold, tokens) texts."""

    def counts(kept):
        return Counter(t for _, s in kept for t in s), Counter(p for _, s in kept for p in zip([None, *s], s, strict=False))

    train = [d for d in docs if d[0] != 0]
    one, two = counts([d for d in train if d[0] != 1])
    n, v = sum(one.values()), len(one)
    steps = lambda x: 2 ** (round(8 * math.log2(x)) / 8) if x else 0.0  # noqa: E731  the events' eighths of an octave
    events = []
    for fold_, s in docs:
        for h, t in zip([None, *s], s, strict=False) if fold_ == 1 else ():
            pair = two[h, t] / one[h] if two[h, t] else 0
            events.append((math.floor(math.log2(one[h])) + 1 if one[h] else 0, steps(pair * (v + 1)), steps(one[t] / n * (v + 1))))
    weights = {b: [1 / 3] * 3 for b in range(32)}
    weights[0] = [0, 0.5, 0.5]
    for _ in range(30):
        total = {b: [0.5] * 3 for b in range(32)}
        for b, x, y in events:
            parts = [weights[b][0] * x, weights[b][1] * y, weights[b][2]]
            for k in range(3):
                total[b][k] += parts[k] / sum(parts)
        total[0][0] = 0
        weights = {b: [x / sum(total[b]) for x in total[b]] for b in total}
    return weights, *counts(train)


def test_lm_scores_are_those_of_the_book(spark, hard_rows):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randrange(1, 40)))) for i in range(150)] + [r[:2] for r in hard_rows if r[0] not in (9, 10)]
    docs = [(zlib.crc32(str(i).encode()) % 10 if i is not None else -1, tokens(t)) for i, t in rows]
    weights, one, two = naive_weights(docs)
    n, v = sum(one.values()), len(one)
    want = Counter()
    for (i, _), (_, s) in zip(rows, docs, strict=True):
        total = 0.0
        for h, t in zip([None, *s], s, strict=False):
            w = weights[math.floor(math.log2(one[h])) + 1 if one[h] else 0]
            total += math.log10(w[0] * (two[h, t] / one[h] if one[h] else 0) + w[1] * one[t] / n + w[2] / (v + 1))
        want[i, len(s), round(total, 6)] += 1
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id"), 10)).collect()
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == want


def test_expectation_finds_the_mixture():
    rng = np.random.default_rng(0)
    pick = rng.choice(3, 20_000, p=[0.6, 0.3, 0.1])
    events = np.column_stack([np.full(20_000, 3), np.where(pick == 0, 50, 0.0), np.where(pick == 1, 20, 0.1), np.ones(20_000)])
    weights = expectation(events)
    assert weights.sum(axis=1) == pytest.approx(1) and weights[0, 0] == 0 and weights[3, 0] > 0.5
    assert bucket_of(np.array([0, 1, 2, 3, 4])).tolist() == [0, 1, 2, 2, 3]
    assert interpolated(Model(0, 0, weights), np.array([0]), np.array([0]), np.array([0]))[0] > 0


def test_classifier_learns(spark):
    rng = random.Random(1)
    good, bad = [f"word{i}" for i in range(300)], ["BUY!!", "click***", "$$$", "win%%%"]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad + good[:20], k=rng.randrange(5, 60)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)], "doc_id long, quality int")
    config = FtrlConfig(train_rows=500)
    examples = training_rows(docs, labels, lambda i: fold(i, 4) != 2, config)
    assert examples.count() == 500
    weights = train(examples, config)
    assert weights == train(examples, config)
    held = score(docs, weights, config).where(fold(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held]) > 0.97


def test_updates_and_scores_are_those_of_the_book(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["good", "Fine", "words", "$$$", "b4d!!"], k=rng.randrange(0, 12))), i % 2) for i in range(60)]
    config = FtrlConfig(bits=10)
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= config.l1:
            return 0.0
        return -(z[k] - math.copysign(config.l1, z[k])) / ((config.beta + math.sqrt(n[k])) / config.alpha + config.l2)

    def shares(text):
        count = Counter(features(_Words(), text, config.bits).tolist())
        return {k: c * config.scale / sum(count.values()) for k, c in count.items()} | {"bias": 1.0}

    for _ in range(config.epochs):
        for _, text, label in rows:
            x = {k: float(np.float32(v)) for k, v in shares(text).items()}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, w = (p - label) * v, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / config.alpha * w
                n[k] += g * g
    want = {i: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in shares(t).items()))) for i, t, _ in rows}
    weights = train(spark.createDataFrame(rows, "key long, text string, label int"), config)
    got = score(spark.createDataFrame(rows, "doc_id long, text string, label int"), weights, config).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-4)


def test_classifier_of_hard_documents(spark, hard, hard_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, None), (None, 1), (13, 1), (77, 0)], "doc_id long, quality int")
    config = FtrlConfig()
    rows = training_rows(hard, labels, lambda i: F.lit(True), config)
    assert sorted(r.key for r in rows.collect()) == [1, 5, 13]
    got = score(hard, train(rows, config), config).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in hard_rows) and all(0 <= r.score <= 1 for r in got)
    untaught = train(training_rows(nothing, labels, lambda i: F.lit(True), config), config)
    assert {r.score for r in score(hard, untaught, config).collect()} == {0.5}
    assert score(nothing, untaught, config).count() == 0


def brute_neighbours(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in rows:
        if q % 5 == 0:
            found = sorted({(-float((a * b).sum()), i) for i, b in rows if i != q})[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # a large group of equal vectors
    rows += [(400, None), (405, [0.0] * 4), (410, [float("nan"), 1.0, 1.0, 1.0]), (415, [float("inf"), 1.0, 1.0, 1.0]), (420, [1.0, 2.0]), (None, [1.0] * 4), (425, [1.0, None, 1.0, 1.0]), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("vector", F.lit("x"))
    want = brute_neighbours(rows[:-1], 7)
    for config in (IndexConfig(), IndexConfig(centroids=4, share=1.0, block=16)):
        got = {}
        for r in ann_search(table, F.col("vec_id") % 5 == 0, 7, config=config).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.rank, r.vec_id) for r in ann_search(few, F.col("vec_id") % 5 == 0, 20).collect()} == {(0, 1, 5), (0, 2, 6), (5, 1, 0), (5, 2, 6)}
    assert ann_search(few.limit(0), F.col("vec_id") % 5 == 0, 20).count() == 0


def test_recall_of_a_partial_walk(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann_search(table, F.col("vec_id") % 20 == 0, 10, config=IndexConfig(centroids=32)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    product = points[::20].astype(float) @ points.astype(float).T
    product[np.arange(150), np.arange(0, 3000, 20)] = -9e9
    best = np.argsort(-product, axis=1)[:, :10]
    assert np.mean([len(found[20 * q] & set(best[q].tolist())) / 10 for q in range(150)]) >= 0.9


def test_walk_passes_cells_in_order():
    rng = np.random.default_rng(6)
    one, two, held = rng.normal(size=6), rng.normal(size=6), rng.integers(0, 3, (6, 6))
    end, cells = walk(one, two, held, 20)
    sums = one[:, None] + two[None, :]
    assert set(cells.tolist()) == set(np.flatnonzero((sums >= end).ravel() & (held.ravel() > 0)).tolist())
    assert held.ravel()[cells].sum() >= min(20, held.sum())


def test_only_passed_cells_are_multiplied():
    rng = np.random.default_rng(7)
    cell, vector, m = np.sort(rng.integers(0, 16, 200)), rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    one, two, sums = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), rng.normal(size=9)
    near = one[:, cell // 4] + two[:, cell % 4]
    for least in (1, 30, 1000):
        runs = cell_runs(cell, least)
        assert [a for a, _ in runs] + [200] == [0] + [b for _, b in runs]
        assert all(a == 0 or cell[a] != cell[a - 1] for a, _ in runs) and all(b - a >= least for a, b in runs[:-1])
        got = passed_products(m, sums, one, two, vector, cell, runs)
        assert np.allclose(got, np.where(near >= sums[:, None] - 1e-9, m @ vector.T, -np.inf))
    assert cell_runs(np.empty(0, np.int64), 5) == []
    # A query whose walk passed nothing here is multiplied with nothing, so not even its broken numbers show.
    assert np.isneginf(passed_products(m * np.nan, sums + 99, one, two, vector, cell, cell_runs(cell, 1))).all()


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.sampled_from([1, 2, 3, 12, 51, 1 << 20]))
def test_packed_keys_and_counts(values, shards):
    keys = np.unique(np.array(values, np.uint64))
    start, back = 0, []
    for shard, end in enumerate(shard_ends(keys, shards)):
        if end > start:
            data = pack_keys(keys[start:end])
            own, size = unpack_keys(data + b"xyz")
            assert size == len(data) and all(int(k) * shards >> 64 == shard for k in own)
            back += own.tolist()
        start = end
    assert back == keys.tolist()
    counts = np.array([v % 2**48 for v in values], np.int64)
    assert from_packed_planes(packed_planes(counts), len(counts)).tolist() == counts.tolist()


def test_words_of_long_texts_are_hashed_by_parts(monkeypatch):
    text = "Ab c\x0bd  " * 500 + "x" * 3_000 + " tail"
    whole = WordHashes().of(text)
    monkeypatch.setattr(common, "PART", 1_000)
    assert WordHashes().of(text).tolist() == whole.tolist() and len(whole) == 1502
