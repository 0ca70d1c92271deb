"""The replay of filter orders against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from codelake.llm import common
from codelake.llm.filter_audit import document_flags, replay_orders


def brute_flags(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, c in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]), strict=True) if c)
        out.append((part or "", fails, i in good, i in toxic))
    return out


def brute_replay(flags):
    out = defaultdict(Counter)
    for part, fails, good, toxic in flags:
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, "".join(order), step]
                if f in fails:
                    c["unique_fails"] += fails == f
                    c["redundant"] += gone
                    if not gone:
                        c["removed"] += 1
                        c["good_lost"] += good
                        c["toxic_lost"] += toxic
                    gone = True
                c["kept"] += not gone
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(c[n] for n in names), shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


@pytest.mark.parametrize("hot", [4096, 0])
def test_audit(spark, hard_rows, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    many = " ".join(f"w{i}" for i in range(250))
    extra = [(20, many), (21, many), (22, many + " #"), (23, "a b " * 150), (24, "A" * 300), (25, many.upper() + " $"), (26, many), (26, many), (27, "word\x0bword\x1cword " * 90)]
    rows = [(i, t, (None, "", "s", "t")[n % 4]) for n, (i, t) in enumerate([r[:2] for r in hard_rows] + extra)]
    labels = [(1, 1, 0), (2, 0, 1), (20, 1, 1), (21, 1, None), (21, 0, 1), (None, 1, 1), (99, 1, 1), (25, None, None), (26, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, 2, True) for r in rows], "doc_id long, text string, source string, id long, failed int, good boolean")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    flags = document_flags(docs, marks)
    want = brute_flags(rows, labels)
    assert Counter((r.part, "".join(f for k, f in enumerate("ABCDE") if r.failed >> k & 1), r.good, r.toxic) for r in flags.collect()) == Counter(want)
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = replay_orders(flags).select(*columns).collect()
    assert len(got) == 600 * 3 and {tuple(r) for r in got} == brute_replay(want)


def test_nothing_and_other_filters(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert replay_orders(document_flags(nothing, labels)).count() == 0
    flags = spark.createDataFrame([("p", 3, True), ("p", 0, False)], "part string, failed int, late boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.late_lost, r.shapley) for r in replay_orders(flags, "XY", ("late",)).collect()}
    assert got == {("XY", 1): (1, 1, 0, 1, 1), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (1, 1, 0, 1, 1), ("YX", 2): (1, 0, 1, 0, 1)}
    with pytest.raises(ValueError, match="filters"):
        replay_orders(flags, "ABCDEFG")


def test_a_text_of_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "Ab " * 400_000, "s"), (2, "x" * 1_000_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert {(r.failed, r.toxic) for r in document_flags(docs, labels).collect()} == {(0b110, True), (0b1, False)}
