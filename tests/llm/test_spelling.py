"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from codelake.llm import spelling
from codelake.llm.spelling import Automaton, near_words, spelling_forms, word_counts


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(count, letters="abé", seed=5):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(count)})


def test_numbers_of_the_automaton():
    words = random_words(600)
    automaton = Automaton(words)
    assert [automaton._rest(automaton.root, 0, w) for w in words] == list(range(len(words)))
    assert automaton._rest(automaton.root, 0, "zzz") == -1 and automaton._rest(automaton.root, 0, words[0][:-1] + "z") == -1
    # Fewer states than a tree of the words would have.
    assert len(automaton.steps) < len({w[:i] for w in words for i in range(len(w) + 1)})
    assert Automaton([]).near("abcde", 2) == set()


def test_each_half_finds_its_slips():
    words = random_words(300)
    forward, backwards = Automaton(words), sorted(w[::-1] for w in words)
    backward = Automaton(backwards)
    for w in words:
        half = len(w) // 2
        found = {words[i] for i in forward.near(w, half)} | {backwards[i][::-1] for i in backward.near(w[::-1], len(w) - half)}
        assert found == {x for x in words if one_apart(w, x)}


def brute_forms(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], form[w], root, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("cell", [50_000, 7])  # 7: beginnings are cut into blocks
def test_forms(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    rng = random.Random(9)
    counts = {w: rng.choice((3, 4, 6, 9, 20, 50, 200)) for w in random_words(250)}
    # A chain of forms, and ties of occurrences and of code points.
    counts |= {"qqqqq" + "r" * k: 3 * 2**k for k in range(9)} | {"ünder": 9, "under": 9, "inder": 3}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = near_words(vocabulary).collect()
    assert Counter((r.word, r.near) for r in pairs) == Counter((a, b) for a in counts for b in counts if one_apart(a, b))
    assert {tuple(r) for r in spelling_forms(vocabulary).collect()} == brute_forms(counts)


def brute_counts(rows, slip):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize(("slip", "held"), [(97, 400_000), (3, 5), (None, 400_000)])
def test_counts(spark, hard, hard_rows, nothing, monkeypatch, slip, held):
    monkeypatch.setattr(spelling, "HELD", held)
    rng = random.Random(1)
    words = ["Wolves", "wolves", "ÉMILE", "émile", "fünfzehn", "abcdef", "a" * 50, "déjà", "x×y÷z"]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(40)] + [r[:2] for r in hard_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in word_counts(docs, slip=slip).collect()} == brute_counts(rows, slip)
    assert word_counts(nothing, slip=slip).count() == 0
    assert spelling_forms(word_counts(nothing)).count() == 0
    assert spelling_forms(word_counts(hard)).columns == ["word", "n", "form", "root", "n_near", "form_n"]


def test_a_text_of_a_megabyte(spark):
    rows = [(1, "hello wörlds " * 100_000), (2, "z" * 1_000_000), (3, "hellos " * 3)]
    got = {r.word: (r.form, r.n) for r in spelling_forms(word_counts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {"hello": (None, 100_000), "wörlds": (None, 100_000), "hellos": ("hello", 3)}
