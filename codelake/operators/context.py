"""Context of files and pull requests, and the texts that prompts and reports are made of, as tables: one row a file, repository or pull request.

Lists are cut by a window rank before they are gathered, so no group is collected whole; how many were cut is counted beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decide
from . import graph
from .links import Links


def listed(rows: DataFrame, key: list[str], order: list, text: Column, most: int, more: str | None = None, sep: str = "\n") -> DataFrame:
    """(key..., n, text): the texts of each key's first `most` rows, joined, with `more` (of the number of the others) behind them if there are any."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = rows.withColumn("__place", place).where(F.col("__place") <= most)
    first = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", text.alias("s")))), lambda x: x["s"]), sep).alias("__text"))
    both = first.join(rows.groupBy(*key).agg(F.count("*").alias("n")), key)
    rest = F.col("n") - most
    full = F.col("__text") if more is None else F.when(rest > 0, F.concat("__text", F.lit(sep), F.format_string(more, rest))).otherwise(F.col("__text"))
    return both.select(*key, "n", full.alias("text"))


def _left(rows: DataFrame, found: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with found's text under `name`, null where there is none, and its number under n_`name`, 0 where there is none."""
    more = found.select(*key, F.col("text").alias(name), F.col("n").alias(f"__{name}"))
    return rows.join(more, key, "left").withColumn(f"n_{name}", F.coalesce(f"__{name}", F.lit(0))).drop(f"__{name}")


def filled(found: DataFrame, keys: DataFrame | None, key: list[str], default: str) -> DataFrame:
    """found(key..., text) with a row for each of keys, the default where it has none; found itself without keys."""
    if keys is None:
        return found
    return keys.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("text", F.lit(default)).alias("text"))


def two_places(value: Column) -> Column:
    """A number with two decimals as C's printf gives it (below 10^13): by its exact binary value, halves to the even digit. format_string goes by the
    shortest decimal instead and takes halves away from zero: 0.285, which lies below its name, is 0.28 here and 0.29 there."""
    x = F.abs(value)
    cents = F.floor(x * 100)
    # How far 200 x lies from the odd number between two cents, without any rounding: both parts of x are short enough for exact products.
    high = x.cast("float").cast("double")
    beyond = (high * 200 - (cents * 2 + 1)) + (x - high) * 200
    cents = cents + ((beyond > 0) | ((beyond == 0) & (cents % 2 == 1))).cast("long")
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(x < 1e13, text).otherwise(F.format_string("%.2f", value))


# Fixed values from here on: the texts of lines, headings and placeholders.
_AT_LINE = "- **%s** (line %d): %s"


def issue_texts(issues: DataFrame, key: str) -> DataFrame:
    """(key, summary, critical, high): the counts of the three worst severities on a line, and the first ten of the two worst."""
    counts = issues.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(f"c_{s}") for s in decide.SEVERITIES[:3]))
    out = _left(counts, listed(issues.where("severity = 'critical'"), [key], ["idx"], F.format_string(_AT_LINE, "filename", "line", "description"), 10, "- ... and %d more critical issues"), [key], "critical")
    out = _left(out, listed(issues.where("severity = 'high'"), [key], ["idx"], F.format_string("- **%s**: %s", "filename", "description"), 10, "- ... and %d more"), [key], "high")
    none = F.col("c_critical") + F.col("c_high") + F.col("c_medium") == 0
    summary = F.when(none, "No major issues detected by static analysis.").otherwise(F.format_string("Critical: %d | High: %d | Medium: %d", "c_critical", "c_high", "c_medium"))
    return out.select(key, summary.alias("summary"), F.coalesce("critical", F.lit("No critical issues detected.")).alias("critical"), F.coalesce("high", F.lit("No high priority issues detected.")).alias("high"))


def files_summary(files: DataFrame, key: str, most: int = 10) -> DataFrame:
    line = F.format_string("- **%s** (%s): +%d -%d", "filename", F.coalesce("language", F.lit("?")), "additions", "deletions")
    return listed(files, [key], ["filename"], line, most, "- ... and %d more files").drop("n")


def files_details(files: DataFrame, key: str, most: int = 15) -> DataFrame:
    """files(key, filename, language, additions, deletions, score, issues)."""
    text = F.format_string("### %s\n- Language: %s\n- Changes: +%d -%d\n- Complexity Score: %d/100\n- Issues: %d", "filename", F.coalesce("language", F.lit("unknown")), "additions", "deletions", "score", "issues")
    return listed(files, [key], ["filename"], text, most, sep="\n\n").drop("n")


def hotspots_text(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, most: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """(repo_id, text): the functions of a repository that call most others; "None detected" for those of keys(repo_id) that have none."""
    counted = repo_hotspots(entities, calls, min_calls)
    return filled(listed(counted, ["repo_id"], ["place"], F.format_string("- %s: %s (%d calls)", "file", "name", "calls"), most).drop("n"), keys, ["repo_id"], "None detected")


def coupling_text(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, most: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """(repo_id, text): the pairs of files with most calls between them; "None detected" for those of keys(repo_id) that have none."""
    pairs = graph.file_dependencies(entities, calls).where(F.col("calls") >= min_calls)
    found = listed(pairs, ["repo_id"], [F.desc("calls"), "file", "depends_on"], F.format_string("- %s ↔ %s (%d connections)", "file", "depends_on", "calls"), most).drop("n")
    return filled(found, keys, ["repo_id"], "None detected")


_NOTHING = "None found - repository may need re-ingestion"


def entities_summary(entities: DataFrame, per_file: int = 5, most: int = 15, keys: DataFrame | None = None) -> DataFrame:
    """(repo_id, text): the first entities of each file, the first files' first; a note for those of keys(repo_id) that have none."""
    own = graph.file_entities(entities, per_file)
    found = listed(own, ["repo_id"], ["file", "rank"], F.format_string("  - %s (%s) in %s", "name", "type", "file"), most)
    return filled(found.select("repo_id", F.concat(F.lit("\n📊 Key Entities (GraphRAG):\n"), "text").alias("text")), keys, ["repo_id"], _NOTHING)


def dependencies_summary(entities: DataFrame, calls: DataFrame | Links, per_file: int = 5, most: int = 15, keys: DataFrame | None = None) -> DataFrame:
    """(repo_id, text): the first calls out of each file; a note for those of keys(repo_id) that have none."""
    if isinstance(calls, Links):
        # Each function's first callees are enough, and of a file's functions the first ones.
        first = calls.callees(per_file).withColumn("__n", F.row_number().over(Window.partitionBy("repo_id", "src_file").orderBy("src_uid"))).where(F.col("__n") <= per_file)
        ends = first.select("repo_id", "src_uid", "src_file", F.explode("first").alias("d")).select("repo_id", "src_uid", "src_file", F.col("d.uid").alias("dst_uid"), F.col("d.name").alias("dst_name"))
        ends = ends.join(calls.entities.select(F.col("uid").alias("src_uid"), F.col("name").alias("src_name")), "src_uid")
    else:
        ends = graph._ends(calls, entities)
    place = F.row_number().over(Window.partitionBy("repo_id", "src_file").orderBy("src_uid", "dst_uid"))
    own = ends.withColumn("place", place).where(F.col("place") <= per_file)
    found = listed(own, ["repo_id"], ["src_file", "place"], F.format_string("  - %s → %s (calls) in %s", "src_name", "dst_name", "src_file"), most)
    return filled(found.select("repo_id", F.concat(F.lit("\n🔗 Dependencies (GraphRAG):\n"), "text").alias("text")), keys, ["repo_id"], _NOTHING)


def compressed_similar(hits: DataFrame, key: str = "query_id", most: int = 3, keys: DataFrame | None = None) -> DataFrame:
    """(key, text): hits(key, rank, file, start_line, type, score) in short; "None found" for those of keys(key) without any."""
    line = F.format_string("- %s:%d (%s, score: %s)", "file", "start_line", "type", two_places(F.col("score")))
    return filled(listed(hits, [key], ["rank"], line, most, "... +%d more").drop("n"), keys, [key], "None found")


def compressed_dependencies(entities: DataFrame, calls: DataFrame | Links, most: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """(repo_id, src_uid, text): what an entity calls, in short; "None" for those of keys(repo_id, src_uid) that call nothing."""
    key = ["repo_id", "src_uid"]
    if isinstance(calls, Links):
        shown = F.array_join(F.transform("first", lambda x: F.format_string("- %s (%s)", x["name"], x["file"])), "\n")
        rest = F.col("calls") - most
        text = F.when(rest > 0, F.concat(shown, F.lit("\n"), F.format_string("... +%d more", rest))).otherwise(shown)
        return filled(calls.callees(most).join(calls.fanout(), key).select(*key, text.alias("text")), keys, key, "None")
    return filled(listed(graph._ends(calls, entities), key, ["dst_uid"], F.format_string("- %s (%s)", "dst_name", "dst_file"), most, "... +%d more").drop("n"), keys, key, "None")


def similar_snippets(hits: DataFrame, key: str = "query_id", most: int = 5, longest: int = 300) -> DataFrame:
    """(key, text): hits(key, rank, file, start_line, score, snippet, reason) with their code, fenced and cut."""
    code = F.when(F.char_length("snippet") > longest, F.concat(F.substring("snippet", 1, longest), F.lit("\n..."))).otherwise(F.col("snippet"))
    fence = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("```"), decide.fence_language(F.col("file")), F.lit("\n"), code, F.lit("\n```\n"))).otherwise("")
    entry = F.concat(F.format_string("\n**%d. %s:L%d** (similarity: %s)\n", "rank", "file", "start_line", two_places(F.col("score"))), fence, F.lit("_"), F.coalesce("reason", F.lit("Similar pattern detected")), F.lit("_\n"))
    return listed(hits, [key], ["rank"], entry, most).drop("n")


def dependency_impact(entities: DataFrame, calls: DataFrame | Links, most: int = 5) -> DataFrame:
    """(repo_id, file, text): what a file depends on and what depends on it, by number of calls."""
    pairs = graph.file_dependencies(entities, calls)
    up = listed(pairs, ["repo_id", "file"], [F.desc("calls"), "depends_on"], F.concat(F.lit("• `"), "depends_on", F.lit("`\n  _Changes to this dependency may require updates here_")), most)
    turned = pairs.select("repo_id", F.col("depends_on").alias("file"), F.col("file").alias("by"), "calls")
    down = listed(turned, ["repo_id", "file"], [F.desc("calls"), "by"], F.concat(F.lit("• `"), "by", F.lit("`\n  _Changes here will affect this file_")), most)
    key = ["repo_id", "file"]
    both = _left(_left(entities.select(*key).distinct(), up, key, "up"), down, key, "down")
    parts = F.concat_ws("\n\n", F.concat(F.lit("**Upstream (what this file depends on):**\n"), "up"), F.concat(F.lit("**Downstream (what depends on this file):**\n"), "down"))
    return both.select(*key, F.when(parts == "", "None - File is isolated").otherwise(parts).alias("text"))


def entity_tree(entities: DataFrame, calls: DataFrame | Links, most: int = 8) -> DataFrame:
    """(repo_id, file, text): the first entities of a file, with what they call, what calls them, and the first files that they use."""
    key = ["repo_id", "uid"]
    if isinstance(calls, Links):
        return _tree(entities, *_called(calls, graph.file_entities(entities, most)), most)
    ends = graph._ends(calls, entities)
    out = listed(ends.withColumnRenamed("src_uid", "uid"), key, ["dst_uid"], F.concat(F.lit("`"), "dst_name", F.lit("`")), 5, sep=", ")
    into = listed(ends.withColumnRenamed("dst_uid", "uid"), key, ["src_uid"], F.concat(F.lit("`"), "src_name", F.lit("`")), 3, sep=", ")
    files = ends.select("repo_id", F.col("src_uid").alias("uid"), "dst_file").distinct()
    uses = listed(files, key, ["dst_file"], F.concat(F.lit("`"), "dst_file", F.lit("`")), 3, sep=", ")
    return _tree(entities, out, into, uses, most)


def _called(links: Links, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The callees, callers and used files that entity_tree shows, of the entities that it shows only."""
    mark = lambda names: F.array_join(F.transform(names, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    own = own.select("repo_id", "uid")
    to_uid = F.col("src_uid").alias("uid")
    first = links.callees(5).join(links.fanout(), ["repo_id", "src_uid"]).select("repo_id", to_uid, "first", "files", "calls").join(own, ["repo_id", "uid"], "left_semi")
    out = first.select("repo_id", "uid", F.col("calls").alias("n"), mark("first.name").alias("text"))
    uses = first.select("repo_id", "uid", F.size("files").alias("n"), mark(F.slice("files", 1, 3)).alias("text"))
    names = links.entities.select(F.col("uid").alias("src_uid"), "name")
    callers = links.callers(own, 3).join(names, "src_uid").groupBy("repo_id", F.col("dst_uid").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("first"))
    into = callers.join(links.fanin().select("repo_id", F.col("dst_uid").alias("uid"), F.col("calls").alias("n")), ["repo_id", "uid"]).select("repo_id", "uid", "n", mark("first.name").alias("text"))
    return out, into, uses


def _tree(entities: DataFrame, out: DataFrame, into: DataFrame, uses: DataFrame, most: int) -> DataFrame:
    key = ["repo_id", "uid"]
    own = _left(_left(_left(graph.file_entities(entities, most), out, key, "calls"), into, key, "callers"), uses, key, "uses")
    line = lambda head, name, shown: F.concat(F.lit(f"├─ {head}: "), name, F.when(F.col(f"n_{name}") > shown, F.format_string(" _(+%d more)_", F.col(f"n_{name}") - shown)).otherwise(""))
    tree = F.concat_ws("\n", F.format_string("**`%s`** (%s)", "name", "type"), line("Calls", "calls", 5), line("Called by", "callers", 3), F.concat(F.lit("└─ Uses: "), "uses"))
    return listed(own, ["repo_id", "file"], ["rank"], tree, most, sep="\n\n").drop("n")


def fallback_report(prs: DataFrame, issues: DataFrame) -> DataFrame:
    """(pr, report): prs(pr, files, additions, deletions, risk, advice) with their issues, as a review without a model."""
    some = "- ... and %d more"
    worst = listed(issues.where("severity = 'critical'"), ["pr"], ["idx"], F.format_string("- ⚠️ **%s** (line %d): %s", "filename", "line", "description"), 5, some)
    bad = listed(issues.where("severity = 'high'"), ["pr"], ["idx"], F.format_string("- ⚠️ **%s**: %s", "filename", "description"), 5, some)
    both = _left(_left(prs, worst, ["pr"], "worst"), bad, ["pr"], "bad")
    below = lambda name: F.coalesce(F.concat(F.lit("\n"), name), F.lit(""))
    head = F.format_string("# Code Review Summary\n\n**Note:** This is an automated summary generated from static analysis. Full AI review could not be completed.\n\n## Overview\n- **Files Changed:** %d\n- **Lines Changed:** +%d -%d\n- **Risk Level:** %s\n\n", "files", "additions", "deletions", F.upper("risk"))
    advice = F.array_join(F.transform("advice", lambda a: F.concat(F.lit("\n- "), a)), "")
    report = F.concat(head, F.format_string("## Critical Issues (%d)\n", "n_worst"), below("worst"), F.format_string("\n\n## High Priority Issues (%d)\n", "n_bad"), below("bad"), F.lit("\n\n## Recommendations\n"), advice)
    return both.select("pr", report.alias("report"))


def context_summary(prs: DataFrame) -> DataFrame:
    """(pr, summary): prs(pr, title, risk, additions, deletions, files, languages, critical, high, medium, callers, advice) in a few lines."""
    lines = F.concat_ws(
        "\n",
        F.format_string("PR #%d: %s", "pr", "title"),
        F.concat(F.lit("Risk Level: "), F.upper("risk")),
        F.format_string("\n📊 Changes: %d additions, %d deletions across %d files", "additions", "deletions", "files"),
        F.concat(F.lit("💻 Languages: "), F.array_join("languages", ", ")),
        F.format_string("\n🐛 Issues: %d critical, %d high, %d medium", "critical", "high", "medium"),
        F.format_string("🎯 Impact: %d affected callers\n", "callers"),
    )
    advice = F.when(F.size("advice") > 0, F.concat(F.lit("\n📝 Recommendations:"), F.array_join(F.transform("advice", lambda a: F.concat(F.lit("\n  • "), a)), ""))).otherwise("")
    return prs.select("pr", F.concat(lines, advice).alias("summary"))


def pr_context(files: DataFrame, issues: DataFrame, impact: DataFrame) -> DataFrame:
    """(pr, ...): totals and languages of files(pr, filename, additions, deletions, language), counts of issues(pr, severity, category) and
    impact(pr, callers), with risk and whether a deep review is due."""
    totals = files.groupBy("pr").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_sort(F.collect_set("language")).alias("languages"))
    is_ = lambda s: F.col("severity") == s
    counts = issues.groupBy("pr").agg(*(F.count_if(is_(s)).alias(s) for s in decide.SEVERITIES[:3]), F.count_if(is_("critical") & (F.col("category") == "security")).alias("security_critical"))
    both = totals.join(counts, "pr", "left").join(impact.select("pr", "callers"), "pr", "left").na.fill(0)
    risk = decide.risk_level(*(F.col(c) for c in ("security_critical", "critical", "high", "callers", "additions")))
    return both.withColumn("risk", risk).withColumn("deep_review", F.col("risk").isin("high", "critical"))


def repo_hotspots(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, limit: int = 10) -> DataFrame:
    """(repo_id, place, file, name, start_line, calls): the functions of each repository that call most others."""
    counted = graph.fanout(calls).withColumnRenamed("src_uid", "uid").where(F.col("calls") >= min_calls)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("calls"), "uid"))
    top = counted.withColumn("place", place).where(F.col("place") <= limit)
    return top.join(entities.select("repo_id", "uid", "file", "name", "start_line"), ["repo_id", "uid"]).select("repo_id", "place", "file", "name", "start_line", "calls")


def related_code(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, limit: int = 30) -> DataFrame:
    """(repo_id, file, place, type, name, at_file, reason, line): what belongs to each file - its entities, callers of its first functions, the
    files it depends on, its hotspots - in this order, at most `limit`."""
    key = ["repo_id", "file"]
    row = lambda section, a, b, kind, name, at, reason, line: (F.lit(section).alias("section"), a.alias("a"), b.alias("b"), F.lit(kind).alias("type"), name.alias("name"), at.alias("at_file"), reason.alias("reason"), line.alias("line"))
    none, c = F.lit(0), F.col
    own = graph.file_entities(entities, 20)
    parts = [own.select(*key, *row(0, c("rank"), none, "file_entity", c("name"), c("file"), F.concat("type", F.lit(" defined in this file")), c("start_line")))]
    first = own.where("type = 'Function'").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where("place <= 5").select(*key, "place", "name")
    callers = graph.callers_by_name(entities, calls, 5).withColumnRenamed("rank", "n")
    parts.append(first.join(callers, ["repo_id", "name"]).select(*key, *row(1, c("place"), c("n"), "caller", c("src_name"), c("src_file"), F.concat(F.lit("Calls function '"), "name", F.lit("'")), c("src_start_line"))))
    deps = graph.file_dependencies(entities, calls).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("calls"), "depends_on"))).where("n <= 5")
    parts.append(deps.select(*key, *row(2, c("n"), none, "file_dependency", F.format_string("%d calls", "calls"), c("depends_on"), F.format_string("File dependency (%d function calls)", "calls"), F.lit(None).cast("int"))))
    parts.append(repo_hotspots(entities, calls, min_calls).select(*key, *row(3, c("place"), none, "complexity_hotspot", c("name"), c("file"), F.format_string("Complexity hotspot: %d outgoing calls", "calls"), c("start_line"))))
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("section", "a", "b", "at_file", "name"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("section", "a", "b")


def file_context(entities: DataFrame, calls: DataFrame | Links, similar: DataFrame | None = None, most: int = 50, related: int = 5, alike: int = 3, longest: int = 200) -> DataFrame:
    """(repo_id, file, name, type, line, related, similar): the first entities of each file, each with the first of what belongs to the file.

    similar(repo_id, file, place, at_file, line, score, snippet, reason) are chunks like the file's; the first `alike` of them are an array of
    structs, their snippets cut, empty where there are none. Without it the column is left out.
    """
    key = ["repo_id", "file"]
    rel = listed(related_code(entities, calls), key, ["place"], F.concat_ws(":", "type", "name"), related, sep=",").select("repo_id", "file", F.col("text").alias("related"))
    out = graph.file_entities(entities, most).join(rel, key, "left").select("repo_id", "file", "name", "type", F.col("start_line").alias("line"), "related")
    if similar is None:
        return out
    place = F.row_number().over(Window.partitionBy(*key).orderBy("place", "at_file", "line"))
    first = similar.withColumn("__place", place).where(F.col("__place") <= alike)
    item = F.struct("__place", F.col("at_file").alias("file"), "score", "line", F.substring(F.coalesce("snippet", F.lit("")), 1, longest).alias("snippet"), F.coalesce("reason", F.lit("")).alias("reason"))
    found = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("__place")).alias("similar"))
    empty = F.array().cast(found.schema["similar"].dataType)
    return out.join(found, key, "left").withColumn("similar", F.coalesce("similar", empty))


def first_match(results: DataFrame, changes: DataFrame, key: list[str], order: list, values: list[str]) -> DataFrame:
    """results with the values of the first row of changes with the same key; null where there is none."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return results.join(changes.withColumn("__first", first).where("__first = 1").select(*key, *values), key, "left")


def top_files(issues: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, place, filename, issues_found): the files with most issues, those that came first before others with as many."""
    counted = issues.groupBy(key, "filename").agg(F.count("*").alias("issues_found"), F.min("idx").alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("issues_found"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "filename", "issues_found")


def word_counts(text: Column) -> tuple[Column, Column]:
    """How often a summary speaks of critical and of high priority."""
    count = lambda word: F.regexp_count(F.lower(text), F.lit(word))
    return count("critical"), count("high priority") + count("high:")


def nodes_by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The entities that bear one of names(repo_id, name)."""
    return entities.join(names.distinct(), ["repo_id", "name"], "left_semi").select("repo_id", "name", "file", "type", "uid")


def graph_export(entities: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo_id, file, nodes, imports, dependencies, total_nodes, total_files): the whole graph, a row a file.

    nodes are all of the file's entities by uid, with their code cut to 500 characters and the uids that they call; imports(repo_id, file, import) and
    dependencies, the files that it imports, are sorted. The totals are the repository's. So a row grows with its file, and with nothing else.
    """
    key = ["repo_id", "file"]
    called = calls.groupBy("repo_id", F.col("src_uid").alias("uid")).agg(F.array_sort(F.collect_list("dst_uid")).alias("calls"))
    node = F.struct("uid", "name", "type", "start_line", "end_line", F.substring("raw_code", 1, 500).alias("code"), F.coalesce("calls", F.array().cast("array<string>")).alias("calls"))
    nodes = entities.join(called, ["repo_id", "uid"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    own = imports.groupBy(*key).agg(F.array_sort(F.collect_set("import")).alias("imports"))
    deps = graph.import_dependencies(imports, entities).groupBy(*key).agg(F.array_sort(F.collect_set("depends_on")).alias("dependencies"))
    totals = entities.groupBy("repo_id").agg(F.count("*").alias("total_nodes"), F.countDistinct("file").alias("total_files"))
    none = F.array().cast("array<string>")
    out = nodes.join(own, key, "left").join(deps, key, "left").join(totals, "repo_id")
    return out.select(*key, "nodes", F.coalesce("imports", none).alias("imports"), F.coalesce("dependencies", none).alias("dependencies"), "total_nodes", "total_files")


def repo_coupling(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, limit: int = 10) -> DataFrame:
    """(repo_id, place, source, target, connections): the pairs of files of each repository with most calls between them."""
    pairs = graph.file_dependencies(entities, calls).where(F.col("calls") >= min_calls)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("calls"), "file", "depends_on"))
    return pairs.withColumn("place", place).where(F.col("place") <= limit).select("repo_id", "place", F.col("file").alias("source"), F.col("depends_on").alias("target"), F.col("calls").alias("connections"))


def _gathered(rows: DataFrame, key: list[str], name: str, order: list[str], *columns: str) -> DataFrame:
    """(key..., name): each key's rows as an array of structs in order."""
    item = F.struct(*order, *(c for c in columns if c not in order))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def pr_impact(changed: DataFrame, entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, limit: int = 10, files: int = 10, per_file: int = 20, per_name: int = 100, unused: int = 20) -> DataFrame:
    """What pull requests touch, a row for each of changed(pr, repo_id, file): (pr, repo_id, affected_callers, high_coupling, hotspots, unused, cross_file).

    The repository's first `limit` pairs of files and hotspots, and its first `unused` functions that nothing calls, are found first, and those of
    the changed files are arrays of structs in that order; so are the limits of the questions that reviews ask. affected_callers counts the
    callers of the functions among the first `per_file` entities of the first `files` changed files (by name), at most `per_name` of a name, each
    time anew. cross_file counts the files that changed files depend on, for each file.
    """
    key, at = ["pr", "repo_id"], ["repo_id", "file"]
    changed = changed.select("pr", "repo_id", "file").distinct()
    coupling = repo_coupling(entities, calls, min_calls, limit)
    ends = coupling.select("repo_id", "place", F.explode(F.array_distinct(F.array("source", "target"))).alias("file"))
    pairs = changed.join(ends, at).select(*key, "place").distinct().join(coupling, ["repo_id", "place"])
    hot = changed.join(repo_hotspots(entities, calls, min_calls, limit).withColumnRenamed("name", "function"), at)
    dead = graph.unused_functions(entities, calls, None)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file", "start_line", "uid"))
    dead = dead.withColumn("place", place).where(F.col("place") <= unused).select(*at, "place", F.col("name").alias("function"), F.col("start_line").alias("line"))
    first = changed.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("file"))).where(F.col("n") <= files)
    functions = first.join(graph.file_entities(entities, per_file).where("type = 'Function'").select(*at, "name"), at)
    callers = graph.calls_by_name(entities, calls).select("repo_id", "name", F.least("calls", F.lit(per_name)).alias("callers"))
    affected = functions.join(callers, ["repo_id", "name"]).groupBy(*key).agg(F.sum("callers").alias("affected_callers"))
    cross = changed.join(graph.file_dependencies(entities, calls), at).groupBy(*key).agg(F.count("*").alias("cross_file"))
    lists = {
        "high_coupling": _gathered(pairs, key, "high_coupling", ["place"], "source", "target", "connections"),
        "hotspots": _gathered(hot, key, "hotspots", ["place"], "file", "function", "calls"),
        "unused": _gathered(changed.join(dead, at), key, "unused", ["place"], "file", "function", "line"),
    }
    out = changed.select(*key).distinct().join(affected, key, "left").join(cross, key, "left")
    for name, found in lists.items():
        out = out.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    return out.select(*key, F.coalesce("affected_callers", F.lit(0)).alias("affected_callers"), *lists, F.coalesce("cross_file", F.lit(0)).alias("cross_file"))


def review_context(prs: DataFrame, files: DataFrame, issues: DataFrame, impact: DataFrame, most: int | None = None) -> DataFrame:
    """The whole context of a review, a row for each of prs(pr, repo_id, title).

    files(pr, filename, language, status, additions, deletions), issues(pr, idx, filename, severity, category, title, description, line, suggestion) and
    impact, as pr_impact gives it. Beside totals, languages, risk and advice there are files, with the counts of their issues and their score, the
    critical, high and medium issues in order of idx, and counts by category; lists are whole, or their first `most` rows.
    """
    key = ["pr"]
    cut = (lambda rows, order: rows) if most is None else (lambda rows, order: rows.withColumn("__n", F.row_number().over(Window.partitionBy("pr").orderBy(*order))).where(F.col("__n") <= most).drop("__n"))
    worst = decide.SEVERITIES[:4]
    per_file = issues.groupBy("pr", "filename").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in worst))
    judged = files.join(per_file, ["pr", "filename"], "left").na.fill(0, list(worst))
    judged = judged.withColumn("score", decide.complexity_score(F.col("additions"), F.col("deletions"), F.col("critical") + F.col("high") + F.col("medium") + F.col("low")))
    out = prs.join(judged.groupBy("pr").agg(
        F.count("*").alias("total_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_sort(F.collect_set("language")).alias("languages"),
        F.count_if(F.col("score") > 70).alias("complex_files"), F.slice(F.array_sort(F.collect_set(F.when(F.col("score") > 70, F.col("filename")))), 1, 3).alias("complex_names"),
    ), key, "left")
    is_ = lambda s, c: F.count_if((F.col("severity") == s) & (F.col("category") == c))
    out = out.join(issues.groupBy("pr").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in worst[:3]), is_("critical", "security").alias("security_critical"), is_("high", "security").alias("security_high"),
        F.count_if(F.col("severity").isin("critical", "high") & (F.col("category") == "code_quality")).alias("quality"),
    ), key, "left")
    by = issues.groupBy("pr", "category").agg(F.count("*").alias("n")).groupBy("pr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("issues_by_category"))
    shown = ("filename", "severity", "category", "title", "description", "line", "suggestion")
    parts = {"files": _gathered(cut(judged, ["filename"]), key, "files", ["filename"], "filename", "language", "status", "additions", "deletions", *worst, "score")}
    for severity in worst[:3]:
        parts[f"{severity}_issues"] = _gathered(cut(issues.where(F.col("severity") == severity), ["idx"]), key, f"{severity}_issues", ["idx"], *shown)
    out = out.join(by, key, "left").join(impact.drop("repo_id"), key, "left")
    for name, found in parts.items():
        out = out.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    counts = ("total_files", "additions", "deletions", "complex_files", *worst[:3], "security_critical", "security_high", "quality", "affected_callers", "cross_file")
    out = out.na.fill(0, list(counts))
    risk = decide.risk_level(*(F.col(c) for c in ("security_critical", "critical", "high", "affected_callers", "additions")))
    coupled = F.coalesce(F.size("high_coupling") > 0, F.lit(False))
    names = F.array_join(F.coalesce("complex_names", F.array().cast("array<string>")), ", ")
    advice = decide.recommendations(F.col("security_critical"), F.col("security_high"), F.col("complex_files"), names, coupled, F.col("affected_callers"), F.col("quality"))
    out = out.withColumn("risk", risk).withColumn("recommendations", advice).withColumn("deep_review", F.col("risk").isin("high", "critical"))
    return out.drop("complex_names")
