"""Operators on hand-made tables."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codelake.engine import Engine
from codelake.functions import decide
from codelake.operators import context, diff, graph, ops, review, rules, vector

ENTITIES = "repo_id string, file string, name string, type string, start_line int, end_line int, raw_code string, uid string"


def entities(spark, rows):
    return spark.createDataFrame([(r, f, n, t, s, s + 5, code, f"{r}::{f}::{n}") for r, f, n, t, s, code in rows], ENTITIES)


@pytest.fixture(scope="module")
def code(spark):
    return entities(
        spark,
        [
            ("r", "a.py", "alpha", "Function", 1, "beta() gamma delta"), ("r", "b.py", "beta", "Function", 2, "gamma alpha"), ("r", "c.py", "gamma", "Class", 3, "alpha beta"),
            ("r", "c.py", "abc", "Function", 9, "alpha"), ("r", "d.py", "main", "Function", 1, None), ("q", "a.py", "alpha", "Function", 1, "beta"), ("r", "a.py", "delta", "Function", 5, ""),
        ],
    )


def edges(calls):
    return {(r.src_uid[3:], r.dst_uid[3:]) for r in calls.collect()}


def test_links(code):
    assert edges(graph.link_dependencies(code)) == {("a.py::alpha", "b.py::beta"), ("a.py::alpha", "c.py::gamma"), ("b.py::beta", "c.py::gamma"), ("b.py::beta", "a.py::alpha"), ("c.py::abc", "a.py::alpha")}


def test_chains_use_a_call_once(spark):
    calls = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c")], "repo_id string, src_uid string, dst_uid string")
    got = graph.call_chains(calls, spark.createDataFrame([("r", "a")], "repo_id string, src_uid string"), 4).collect()
    assert sorted((r.depth, r.path) for r in got) == [(1, "a > b"), (2, "a > b > a"), (2, "a > b > c")]


def test_unused_and_callers(code):
    calls = graph.link_dependencies(code)
    assert {r.name for r in graph.unused_functions(code, calls).collect()} == {"abc", "alpha", "delta"}
    assert {(r.name, r.caller) for r in graph.callers_of(code, calls).collect()} >= {("alpha", "beta"), ("alpha", "abc")}


def test_upsert_replaces_a_file_and_the_last_capture_wins(spark, code):
    new = code.where("file = 'c.py'").withColumn("capture_idx", F.col("start_line")).unionByName(code.where("name = 'abc'").withColumn("raw_code", F.lit("new")).withColumn("capture_idx", F.lit(99)))
    got = {r.uid: r.raw_code for r in graph.upsert_entities(code, new).where("repo_id = 'r' and file = 'c.py'").collect()}
    assert got == {"r::c.py::gamma": "alpha beta", "r::c.py::abc": "new"}


@pytest.mark.parametrize(("files", "additions", "risk", "want"), [(2, 50, "low", "quick"), (5, 250, "medium", "standard"), (12, 800, "high", "deep"), (8, 600, "medium", "deep"), (3, 100, "critical", "deep"), (3, 100, "low", "quick"), (4, 100, "low", "standard"), (3, 101, "low", "standard"), (10, 500, "medium", "standard"), (11, 1, "low", "deep"), (1, 501, "low", "deep")])
def test_routing(spark, files, additions, risk, want):
    assert spark.range(1).select(decide.review_strategy(F.lit(files), F.lit(additions), F.lit(risk), F.lit(False))).first()[0] == want


def test_queue_priorities(spark):
    rows = spark.createDataFrame([(c,) for c in (99, 100, 499, 500, 999, 1000)], "c int").select(decide.queue_priority(F.col("c")).alias("p")).collect()
    assert [r.p for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_validators(spark):
    paths = ["a/b.py", "../x", "a/../../x", "/etc", "a\0b", "a/./b/../c", None, "x" * 501]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(decide.valid_path(F.col("p"))).collect()]
    assert got == [True, False, False, False, False, True, False, False]
    ids = spark.createDataFrame([("valid-repo_123",), ("a/b",), ("a\n",)], "p string").select(decide.valid_repo_id(F.col("p"))).collect()
    assert [r[0] for r in ids] == [True, False, False]


POSITIVE = {"password": "password = 'x'", "double_equals": "a === b", "exec": "re.exec(x)", "py_type_check": "type(a) == b", "js_jquery_chain": "$(a).b(c).d(e).f", "go_ignored_error": "_ = err", "todo": "# fixme", "append": "x.append(1)  "}


def test_rules(spark):
    lines = spark.createDataFrame([(k, v, {"py": "python", "js": "js", "go": "Go"}.get(k[:2])) for k, v in POSITIVE.items()] + [("none", "password = 'long'", None)], "k string, line string, language string")
    got = defaultdict(set)
    for r in rules.line_issues(lines).collect():
        got[r.k].add(r.rule)
    assert all(k in got[k] for k in POSITIVE) and not got["none"]


def test_complexity_and_metrics(spark):
    text = "if a:\n  x ? y : z\nelse if b && c or d:\n\n# note\n"
    r = spark.createDataFrame([(text,)], "t string").select(rules.complexity(F.col("t")).alias("c")).first()
    assert r.c == 1 + 2 + 1 + 1 + 1 + 1
    m = rules.file_metrics(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (m.total, m.code, m.comments, m.blank) == (6, 3, 1, 2)


PATCH = "@@ -3,3 +3,4 @@\n ctx\n-old\n+new\n+++lost\n+more\n@@ -20 +21 @@\n+tail"


def test_diffs(spark):
    patches = spark.createDataFrame([(1, "a.py", PATCH), (2, "b.py", None)], "pr int, filename string, patch string")
    assert [(r.type, r.content) for r in diff.patch_lines(patches, "pr").orderBy("pos").collect()] == [("delete", "old"), ("add", "new"), ("add", "more"), ("add", "tail")]
    shown = [r.shown for r in diff.numbered_diff(patches, "pr").orderBy("pos").collect()]
    assert shown[1:4] == ["L3  | ctx", "L4- | old", "L4+ | new"] and shown[5] == "L5+ | more" and shown[-1] == "L21+ | tail"
    assert [(r.first, r.last) for r in diff.hunk_ranges(patches, "pr").orderBy("first").collect()] == [(3, 7), (21, 22)]
    refs = spark.createDataFrame([(1, "a.py", 7), (1, "unknown", 22), (1, "a.py", 8), (1, "zz.py", 4)], "pr int, file string, line int")
    assert {(r.file, r.line): r.in_diff for r in diff.lines_in_diff(refs, patches, "pr").collect()} == {("a.py", 7): True, ("unknown", 22): True, ("a.py", 8): False, ("zz.py", 4): False}


def test_greedy_dedupe_keeps_order(spark):
    texts = ["a b c d e", "a b c d e f", "", "", "a b c d", "x y", "e d c b a"]
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, idx long, t string")
    kept = []
    for i, t in enumerate(texts):
        w = set(t.split())
        if not any(w and v and len(w & v) / len(w | v) >= 0.8 for _, v in kept):
            kept.append((i, w))
    assert sorted(r.idx for r in review.greedy_dedupe(rows, "g", ["idx"], "t").collect()) == [i for i, _ in kept]


def requests(spark, n=400):
    rng = random.Random(2)
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, rng.randrange(3), rng.choice(["a", "b"]), at + dt.timedelta(seconds=rng.randrange(600)), 1) for i in range(n)] + [(n, 9, "a", at, 1), (n + 1, 9, "a", at + dt.timedelta(seconds=60), 1)], "id long, installation long, endpoint string, ts timestamp, tokens long")


def model_admissions(rows, seconds, limit):
    log, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        key = (r.installation, r.endpoint)
        recent = [t for t in log[key] if t > r.ts - dt.timedelta(seconds=seconds)]
        out[r.id] = len(recent) < limit
        log[key] = [*recent, r.ts] if out[r.id] else recent
    return out


def test_admissions(spark):
    table = requests(spark)
    got = {r.id: r.admitted for r in ops.admissions(table, 60, 3, "installation", "endpoint").collect()}
    assert got == model_admissions(table.collect(), 60, 3) and not all(got.values())
    assert {r.id: r.admitted for r in ops.admissions(table.where("installation = 9"), 60, 1, "installation", "endpoint").collect()} == {400: True, 401: True}


def model_decisions(rows, seconds, limits):
    """The limiter, one request after the other."""
    log, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        recent = [(t, n) for t, n in log[r.installation, r.endpoint] if t > r.ts - dt.timedelta(seconds=seconds)]
        used, limit = sum(n for _, n in recent), limits.get(r.endpoint, limits["default"])
        ok = used + r.tokens <= limit
        retry = 0 if ok or not recent else int(seconds - (r.ts - recent[0][0]).total_seconds())
        out[r.id] = (ok, used, retry, ok and used + r.tokens > 0.8 * limit)
        log[r.installation, r.endpoint] = [*recent, (r.ts, r.tokens)] if ok else recent
    return out


def test_decisions_by_tokens(spark):
    table = requests(spark, 3000).withColumn("tokens", (1 + F.col("id") % 4).cast("int")).withColumn("installation", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("installation")))
    limits = {"a": 9, "b": 25, "default": 12}
    limit = F.when(F.col("endpoint") == "a", 9).when(F.col("endpoint") == "b", 25).otherwise(12)
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.id: (r.admitted, r.used, r.retry_after, r.warned) for r in ops.rate_decisions(table, 60, limit, "installation", "endpoint").collect()}
        assert got == model_decisions(table.collect(), 60, limits)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {v[0] for v in got.values()} == {v[3] for v in got.values()} == {True, False} and max(v[2] for v in got.values()) > 10
    assert {r.c: r.n for r in spark.createDataFrame([("ingestion",), ("webhook",), ("other",)], "c string").select("c", ops.class_limit(F.col("c")).alias("n")).collect()} == {"ingestion": 10, "webhook": 100, "other": 120}


def test_locks(spark):
    at = dt.datetime(2024, 1, 1)
    asks = spark.createDataFrame([(i, "r", at + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 1799, 1800, 3000))], "id long, repo string, ts timestamp")
    assert [r.granted for r in ops.lock_replay(asks, "repo").orderBy("id").collect()] == [True, False, False, True, False]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, want double").select(vector.cosine(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == pytest.approx(r.want) for r in got)


def test_neighbour_blocks(spark):
    rng = random.Random(0)
    rows = [(i, f"r{i % 2}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, repo_id string, embedding array<float>")
    one, many = (sorted(map(tuple, vector.neighbours(chunks, 3, 0.1, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) > 60


def test_text_checks(spark):
    quotes = "```py\nx = 1\n```\nand `a_rather_long_quote` here"
    near, far = "You should test line 12", "you should test. " + "x" * 200 + " line 12, it Could be improved"
    metrics = "cyclomatic complexity of 12, Cyclomatic complexity of 3 and complexity score of 4; 7/10 score"
    texts = [quotes, near, far, metrics, "consider implementing it; it would be better; recommend adding a test", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", review.text_checks()("t").alias("c")).orderBy("i").collect()
    assert [tuple(r.c) for r in rows] == [(2, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 2 * 2 + 1 + 1), (0, 3, 0), (0, 0, 0)]
    pair = spark.createDataFrame([(quotes, "+x = 1\n+other"), ("`nothing of this kind is there`", "+x")], "t string, p string").select(review.quotes_in_patches()("t", "p").alias("q")).collect()
    assert [tuple(r.q) for r in pair] == [(2, 0), (0, 1)]
    assert review.quote_in_patch("short", "") and not review.quote_in_patch("a quote that is long enough", "other")


def test_classes_of_paths_and_errors(spark):
    paths = {"/api/Process": "default", "/api/process": "ingestion", "/x/ingest/search": "ingestion", "/context": "search", "/reviews": "review", "/generate": "review", "/webhook/x": "webhook", "ingest": "default", None: "default"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", decide.endpoint_class(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == paths
    errors = {"Permission denied": "ACCESS_DENIED", "no access": "ACCESS_DENIED", "File Not Found": "NOT_FOUND", "request timed out": "INTERNAL_ERROR", None: "INTERNAL_ERROR"}
    got = spark.createDataFrame([(e,) for e in errors], "e string").select("e", decide.error_class(F.col("e")).alias("c")).collect()
    assert {r.e: r.c for r in got} == errors


def test_compression_of_snippets(spark):
    lines = [str(i) for i in range(25)]
    rows = spark.createDataFrame([("\n".join(lines),), ("\n".join(lines[:20]),)], "t string").select(decide.compress_snippet(F.col("t")).alias("s")).collect()
    assert rows[0].s.split("\n") == [*lines[:10], "... (5 lines omitted) ...", *lines[15:]] and rows[1].s.split("\n") == lines[:20]


def test_events_of_sections(spark):
    rows = [(1, "critical", "x")] + [(2, "high", "x")] * 3 + [(3, "low", "a Security hole"), (4, "critical", "security")]
    issues = spark.createDataFrame(rows, "pr int, severity string, description string")
    assert {r.pr: r.event for r in review.event_by_sections(issues, "pr").collect()} == {1: "REQUEST_CHANGES", 2: "COMMENT", 3: "COMMENT", 4: "REQUEST_CHANGES"}
    assert {r.pr: r.event for r in review.event_by_sections(issues, "pr", critical=2, approve=2).collect()} == {1: "APPROVE", 2: "COMMENT", 3: "APPROVE", 4: "REQUEST_CHANGES"}


def test_joined_paths_stay_below_their_base(spark, tmp_path):
    assert decide.safe_join("/app/repos", "user_repo", "file.py") == "/app/repos/user_repo/file.py"
    assert decide.safe_join("s3://b/x/", "a/../b") == "s3://b/x/a/../b"
    for bad in (("../etc/passwd",), ("a", "../../x"), ("/etc",), ("a\0",)):
        with pytest.raises(ValueError, match="leads out"):
            decide.safe_join("/app/repos", *bad)
    for bad in ("../..", "a/b", ""):
        with pytest.raises(ValueError, match="letters"):
            Engine(spark, str(tmp_path)).delete(bad)


def test_lists_tell_how_many_were_left_out(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 2), ("b", 5)) for i in range(n)], "k string, i int")
    got = {r.k: (r.n, r.text) for r in context.listed(rows, ["k"], ["i"], F.format_string("- %d", "i"), 3, "... +%d more").collect()}
    assert got == {"a": (2, "- 0\n- 1"), "b": (5, "- 0\n- 1\n- 2\n... +2 more")}


def test_defaults_of_prompts(spark, code):
    calls = graph.link_dependencies(code).where("repo_id = 'r'")
    keys = spark.createDataFrame([("r",), ("none",)], "repo_id string")
    text = lambda frame: {r.repo_id: r.text for r in frame.collect()}
    assert text(context.hotspots_text(code, calls, 2, keys=keys)) == {"r": "- a.py: alpha (2 calls)\n- b.py: beta (2 calls)", "none": "None detected"}
    assert text(context.coupling_text(code, calls, 9, keys=keys)) == {"r": "None detected", "none": "None detected"}
    assert text(context.entities_summary(code, keys=keys))["none"] == text(context.dependencies_summary(code, calls, keys=keys))["none"] == "None found - repository may need re-ingestion"
    own = spark.createDataFrame([("r", "r::c.py::gamma"), ("r", "r::c.py::abc")], "repo_id string, src_uid string")
    assert {r.src_uid: r.text for r in context.compressed_dependencies(code, calls, keys=own).collect()} == {"r::c.py::gamma": "None", "r::c.py::abc": "- alpha (a.py)"}
    hits = spark.createDataFrame([(1, 1, "a.py", 3, "Function", 0.5)], "query_id int, rank int, file string, start_line int, type string, score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r.query_id: r.text for r in context.compressed_similar(hits, keys=asked).collect()} == {1: "- a.py:3 (Function, score: 0.50)", 2: "None found"}


def test_trees_of_entities_tell_the_files_they_use(code):
    got = {(r.repo_id, r.file): r.text for r in context.entity_tree(code, graph.link_dependencies(code)).collect()}
    assert got["r", "b.py"] == "**`beta`** (Function)\n├─ Calls: `alpha`, `gamma`\n├─ Called by: `alpha`\n└─ Uses: `a.py`, `c.py`"
    assert got["r", "d.py"] == "**`main`** (Function)"


def test_export_of_a_graph_is_whole(spark, code):
    imports = spark.createDataFrame([("r", "a.py", "b.py"), ("r", "a.py", "os"), ("r", "b.py", "zz.py")], "repo_id string, file string, import string")
    many = entities(spark, [("m", "x.py", f"name{i:04d}", "Function", i, "y" * 600) for i in range(300)])
    got = {(r.repo_id, r.file): r for r in context.graph_export(code.unionByName(many), graph.link_dependencies(code), imports).collect()}
    assert [n.name for n in got["r", "a.py"].nodes] == ["alpha", "delta"] and got["r", "a.py"].nodes[0].calls == ["r::b.py::beta", "r::c.py::gamma"]
    assert got["r", "a.py"].imports == ["b.py", "os"] and got["r", "a.py"].dependencies == ["b.py"] and got["r", "b.py"].dependencies == []
    assert (got["r", "c.py"].total_nodes, got["r", "c.py"].total_files) == (6, 4)
    assert len(got["m", "x.py"].nodes) == 300 and len(got["m", "x.py"].nodes[0].code) == 500


def test_names_and_imports_of_odd_nodes(spark):
    from codelake.sources import ingest

    rows = [("f", "x\ny", ["i"], 3), (None, "'one line'", ["i"], 3), (None, "a\nb", ["first", "second"], 3), (None, "a\nb", [], 7), (None, "a\nb", None, 8)]
    got = spark.createDataFrame(rows, "name string, code string, ids array<string>, line int").select(ingest.entity_name(F.col("name"), F.col("code"), F.col("ids"), F.col("line")).alias("n")).collect()
    assert [r.n for r in got] == ["f", "one line", "first", "anon_7", "anon_8"]
    texts = {"py": "import a, b\n  from .x.y import z\nimport  os\nimporting\n", "jsx": "import x from 'lib/a';\nimport {b} from \"./from/c\"\nconst from = import('z')\n", "go": "import x"}
    files = spark.createDataFrame([("r", k, k, v) for k, v in texts.items()], "repo_id string, file string, language string, text string")
    found = defaultdict(set)
    for r in ingest.imports(files).collect():
        found[r.file].add(r["import"])
    assert found == {"py": {"a,", ".x.y", "os"}, "jsx": {"lib/a", "./", "= import('z')"}}


def test_whole_diffs(spark):
    rows = [(1, "a.py", PATCH), (2, None, "@@ -1 +1 @@\n+x"), (3, "c.py", None), (4, "d.py", " \n"), (5, "", "no hunk")]
    got = {r.pr: r.text for r in diff.formatted_diff(spark.createDataFrame(rows, "pr int, filename string, patch string"), "pr", file_col="filename").collect()}
    assert got[1].startswith("## File: a.py\n\n\n@@ -3,3 +3,4 @@\nL3  | ctx\nL4- | old\nL4+ | new\n") and "\n\n@@ -20 +21 @@\nL21+ | tail" in got[1]
    assert got[2] == "\n@@ -1 +1 @@\nL1+ | x" and got[3] == got[4] == "No diff available" and got[5] == "no hunk"


def test_ties_in_an_overlay_are_ordered(spark):
    schema = "repo string, name string, file string, idx int"
    base = [("r", "n", f, 1) for f in ("z", "a", "m")] + [("r", "own", "q", 1), ("r", "", "q", 1), ("r", None, "q", 1)]
    over = [("r", "n", f, 2) for f in ("y", "b")] + [("s", "n", None, 2), ("s", "n", "c", 2)]
    for seed in range(3):
        a, b = (spark.createDataFrame(random.Random(seed).sample(x, len(x)), schema).repartition(3) for x in (base, over))
        assert {(r.repo, r.name, r.file, r.source) for r in review.overlay_merge(a, b, "repo", "name").collect()} == {("r", "n", "b", "temporary"), ("s", "n", None, "temporary"), ("r", "own", "q", "permanent")}


def test_sections_and_recovery(spark):
    issues = [(1, "critical", "a Security hole")] * 6 + [(1, "medium", "security")] + [(2, "low", "security")] + [(3, "high", "x")] * 11
    got = {(r.pr, r.section): (r.issues, r.collapsible) for r in review.review_sections(spark.createDataFrame(issues, "pr int, severity string, description string"), "pr").collect()}
    assert got == {(1, 1): (6, True), (1, 2): (7, False), (3, 2): (11, True)}
    rows = [("Rate Limit hit", 0), ("rate limit", 2), ("bad API key", 0), ("Authentication", 9), ("x", 0), ("x", 1), ("x", 2), ("x", 3), (None, None)]
    got = [r.r.action for r in spark.createDataFrame(rows, "m string, n int").select(decide.error_recovery(F.col("m"), F.col("n")).alias("r")).collect()]
    assert got == ["retry_later", "end", "fail", "fail", "retry", "retry", "end", "fallback", "retry"]


def test_names_are_found_by_automata_in_any_blocks(spark, monkeypatch):
    rng = random.Random(4)
    names = ["".join(rng.choices("abé😀", k=rng.randint(1, 7))) for _ in range(80)]
    rows = [("r" if i % 3 else "q", f"f{i % 6}.py", f"{n}", rng.choice(["Function", "Class", "Module"]), i, "".join(rng.choices("abé😀", k=200)) if i % 9 else None) for i, n in enumerate(dict.fromkeys(names))]
    table = entities(spark, rows)
    want = {(s.uid, t.uid) for s in table.collect() for t in table.collect() if s.repo_id == t.repo_id and s.file != t.file and s.type == "Function" and t.type in graph.TARGET_TYPES and len(t.name) > 3 and s.raw_code and t.name in s.raw_code}
    for block, part in ((2_000, 50_000), (3, 4)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "PART", part)
        found = [(r.src_uid, r.dst_uid) for r in graph.link_dependencies(table).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_near_rows_leave_in_order_with_any_first(spark):
    """Groups of drifting texts, in which what stays depends on what stayed before it."""
    rng = random.Random(6)
    rows = []
    for g in "ab":
        base = [f"w{i}" for i in range(20)]
        for i in range(120):
            base = list(base)
            base[rng.randrange(20)] = f"n{rng.randrange(40)}"
            rows.append((g, i, " ".join(base) if i % 10 else " ".join(rng.choices(base, k=3))))
    want = defaultdict(list)
    for g, i, t in rows:
        w = set(t.split())
        if not any(len(w & v) >= 0.8 * len(w | v) for _, v in want[g]):
            want[g].append((i, w))
    table = spark.createDataFrame(rows, "g string, idx long, t string").repartition(4)
    for first in (1, 64):
        got = review.greedy_dedupe(table, "g", ["idx"], "t", first=first).collect()
        assert {g: sorted(r.idx for r in got if r.g == g) for g in "ab"} == {g: [i for i, _ in v] for g, v in want.items()}
