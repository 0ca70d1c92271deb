"""Benchmark decontamination against brute force."""

import random
import re
from collections import Counter

import pytest

from codelake.llm import decontaminate
from codelake.llm.decontaminate import contamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= {str(n) for n in found if n is not None}
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return Counter(out)


def result(frame):
    got = []
    for r in frame.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        got.append((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])))
    return Counter(got)


ITEMS = "item_id long, text string, row long, gram long, size int"


def item_rows(items):
    return [(i, t, 1, 1, 1) for i, t in items]


@pytest.mark.parametrize("chunk", [4096, 2])
def test_hard_documents(spark, hard, hard_rows, nothing, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    items = [(1, "The quick-brown FOX jumps over the lazy dog and runs away"), (2, "one"), (3, None), (4, ""), (5, "zählt ½"), (None, "big bad wolf"), (None, "and trailing"), (7, "..."), (8, "w5x w6x w7x w8x w9x w10x w11x w12x w13x w14x w15x"), (2, "row without"), (9, "One")]
    frame = spark.createDataFrame(item_rows(items), ITEMS)
    want = brute([r[:2] for r in hard_rows], items)
    assert result(contamination(hard, frame)) == want
    assert any(r[2] and not r[3] for r in want)  # an item without an id hits words and isn't named
    assert contamination(nothing, frame).count() == 0
    clean = result(contamination(hard, frame.limit(0)))
    assert sum(clean.values()) == len(hard_rows) and all(r[2] == 0 for r in clean)


@pytest.mark.parametrize("window", [10, 3])
def test_passages_in_random_documents(spark, window):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 2, 3, 5, 9, 10, 11, 30))))) for i in range(12, 40)]
    common = " ".join(rng.choices(words, k=14))  # several items share a passage
    items += [(i, common + " tail " + str(i)) for i in range(100, 110)]
    docs = []
    for i in range(150):
        text = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(items)[1].split()
            a = rng.randrange(len(passage))
            at = rng.randint(0, len(text))
            text[at:at] = passage[a : a + rng.randint(1, 14)]
        docs.append((i, (" " if i % 2 else ", ").join(text).upper()))
    docs += [(1000 + i, common) for i in range(80)]  # one window has most of the places
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window)
    assert result(got) == brute(docs, items, window)


def test_a_text_of_a_megabyte(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, ("filler words go here " * 30_000 + passage + " ") * 2), (2, "x" * 1_500_000 + " " + passage)]
    items = [(5, passage), (6, "filler words")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == Counter({(1, 240_120, 120_120, ("5", "6")): 1, (2, 61, 60, ("5",)): 1})
