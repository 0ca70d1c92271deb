"""Operators and adapters do the whole job: no row, text or step is left out."""

import datetime as dt
import random
import re

from codelake.operators import graph, review, rules
from codelake.plans import catalog


def greedy(texts):
    kept = []
    for i, t in enumerate(texts):
        w = set((t or "").lower().split())
        if not any(w and v and len(w & v) >= 0.8 * len(w | v) for _, v in kept):
            kept.append((i, w))
    return [i for i, _ in kept]


def test_greedy_dedupe_takes_all_rows_and_whole_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    same = " ".join(f"start{i}" for i in range(60))  # longer than 300 characters
    groups = {
        "a": [" ".join(rng.sample(words, rng.randrange(1, 12))) for _ in range(700)],
        "b": [same + " " + " ".join(f"{k}end{i}" for i in range(40)) for k in range(4)] + [same] * 3 + [None, "", " "],
        "c": ["x y z"] * 300 + ["another text", "ANOTHER text"],
        None: ["one", "two", "one"],
    }
    rows = spark.createDataFrame([(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts)], "g string, idx long, t string").repartition(5)
    got = review.greedy_dedupe(rows, "g", ["idx"], "t").collect()
    want = {g: greedy(texts) for g, texts in groups.items()}
    assert {g: sorted(r.idx for r in got if r.g == g) for g in groups} == want
    assert all(r.place == r.idx + 1 for r in got) and len(want["a"]) > 200


def test_every_order_has_a_patch(spark, tmp_path):
    lines = [(k, n, n + 1, n + 2, 1.0, "ARN"[n % 3]) for k in range(1, 13) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "1-URGENT") for k in range(1, 13)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for name, rows in (("patch_lines", 24), ("patch_hunks", 12), ("patch_metrics", 12), ("numbered_diff", 48), ("snippet_around", 12), ("line_refs_in_diff", 12), ("pr_content", 12)):
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert {r.pr for r in got} == set(range(1, 13)) and len(got) == rows, name


def test_every_event_is_an_issue(spark, tmp_path):
    spark.createDataFrame([(i, i % 4 + 1) for i in range(1, 41)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, k, "1-URGENT", "F") for k in range(1, 5)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")  # a report is of a pull request
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.idx for r in run("visible_issues")} == set(range(1, 41))
    for name in ("severity_counts", "category_counts"):
        assert sum(r.issues for r in run(name)) == 40, name
    assert sum(r.issues_found for r in run("file_review_links")) == 40
    assert sum(r.total for r in run("file_severity_histogram")) == sum(i % 7 != 4 for i in range(1, 41))
    for name in ("issue_buckets", "event_type_b", "inline_eligible", "fallback_report"):
        assert {r.pr for r in run(name)} == {1, 2, 3, 4}, name
    found = [int(n) for r in run("fallback_report") for n in re.findall(r"Issues \((\d+)\)", r.report)]
    assert sum(found) == sum(i % 7 in (0, 1) for i in range(1, 41))


def test_locks_are_replayed_for_all_endpoints(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    events = [(i, i % 2, ("signup", "view", "error")[i % 3], at + dt.timedelta(hours=7 * i)) for i in range(30)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    want, held = {}, {}
    for i, user, _, ts in events:
        want[i] = user not in held or ts - held[user] >= dt.timedelta(days=1)
        if want[i]:
            held[user] = ts
    assert {r.id: r.granted for r in catalog.queries()["lock_replay"](spark, str(tmp_path)).collect()} == want


def test_every_document_has_a_complexity(spark, tmp_path):
    texts = ["if if else if ELSE\u00a0IF", "größe if éif ifé wenn_if if", "für or über and", None, "", "a ? b : c ? d : e\n?:", "do\u2003while\tcase\nswitch catch except for", "x && y || z elif", "中if or文 or", "if" * 3]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: 1 + sum(len(re.findall(b, t or "", re.I)) for b in rules.BRANCHES) for i, t in enumerate(texts)}
    assert {r.doc_id: r.complexity for r in catalog.queries()["complexity_regex"](spark, str(tmp_path)).collect()} == want


def test_similar_names_meet_every_function(spark):
    rng = random.Random(8)
    some = ["get", "set", "_", "", "getab", "set_a", "abc_abc"] + ["".join(rng.choices("abc_", k=rng.randrange(1, 9))) for _ in range(60)]
    ents = [(r, f"f{n % 4}", name, ("Function", "Function", "Class")[n % 3], f"u{n}") for n, (r, name) in enumerate((rng.choice("pq"), rng.choice(some)) for _ in range(300))]
    table = spark.createDataFrame(ents, "repo_id string, file string, name string, type string, uid string").repartition(5)
    got = graph.similar_names(table, table.select("repo_id", table.name.alias("fn")), 5).collect()
    want = set()
    for repo, fn in {(e[0], e[2]) for e in ents}:
        term = fn.replace("get", "").replace("set", "").replace("_", "")
        near = sorted((e for e in ents if e[0] == repo and e[3] == "Function" and (term in e[2] or (e[2] in term and e[2] != fn))), key=lambda e: e[4])
        want |= {(repo, fn, e[2], e[1], n) for n, e in enumerate(near[:5], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
