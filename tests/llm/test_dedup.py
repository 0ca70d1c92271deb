"""Exact dedup and the n-gram Jaccard join, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from codelake.llm import common
from codelake.llm.exact_dedup import drop_exact_copies, exact_dedup
from codelake.llm.graph import components
from codelake.llm.shingle_join import prefix_size, shingle_components


def expected_verdicts(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(content.encode()).hexdigest()) for i, _ in members]
    return Counter(out)


@pytest.mark.parametrize("hot", [4096, 0])  # all groups are hot, none is
def test_exact(hard, hard_rows, nothing, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    got = Counter(tuple(r) for r in exact_dedup(hard, digest_all=True).collect())
    assert got == expected_verdicts([r[:2] for r in hard_rows])
    partial = exact_dedup(hard).collect()
    assert all(r.digest is not None for r in partial if r.group_size > 1)
    assert exact_dedup(nothing).count() == 0


def test_only_one_of_each_group_stays(hard, nothing):
    left = drop_exact_copies(hard)
    assert left.columns == hard.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[None] == 2 and ids[7] == 1 and ids[13] == 0 and ids[8] == 1 and ids[3] == 1 and ids[1] == 1
    assert drop_exact_copies(nothing).count() == 0


def test_repeated_rows_of_the_one_that_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_exact_copies(docs).collect()) == [1, 3]


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_of_hard_documents(hard, hard_rows, nothing, n, percent):
    got = Counter(tuple(r) for r in shingle_components(hard, n, percent).collect())
    assert got == brute_components([r[:2] for r in hard_rows], n, percent)
    assert shingle_components(nothing, n, percent).count() == 0


def test_components_of_a_drifting_group_and_a_common_passage(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], rng.choices(words, k=60)
    for i in range(60):  # each is near the one before it, the ends are far apart
        base = list(base)
        base[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    passage = " ".join(rng.choices(words, k=30))
    rows += [(100 + i, passage + " " + " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(40)]
    rows += [(200 + i, " ".join(rng.choices(words[:4], k=3))) for i in range(20)]
    got = Counter(tuple(r) for r in shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_prefix_size_is_enough():
    for n in range(1, 200):
        # Without any of the prefix, too few shingles are left to reach the similarity with a set of any size.
        assert n - prefix_size(n, 85) < -(-85 * n // 100)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
