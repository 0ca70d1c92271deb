"""Queries over contexts, prompts and reports; see catalog.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decide
from ..operators import context, diff, export, review, vector
from .catalog import _REASON, Tables, _asks, _rated, _top, query


def _list(rows: str, key: str, order: str, text: str, most: int, more: str | None = None, sep: str = "chr(10)") -> str:
    """SQL of listed(): key, n, text."""
    last = f" || CASE WHEN max(n_) > {most} THEN {sep} || {more.replace('%d', f'(max(n_) - {most})')} ELSE '' END" if more else ""
    return f"""SELECT {key}, max(n_) AS n, string_agg({text}, {sep} ORDER BY r_) FILTER (r_ <= {most}){last} AS text
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r_, count(*) OVER (PARTITION BY {key}) AS n_ FROM ({rows})) GROUP BY {key}"""


def _more(text: str) -> str:
    a, b = text.split("%d")
    return f"'{a}' || %d || '{b}'"


_CRITICAL = _list("SELECT * FROM {issues} WHERE severity = 'critical'", "pr", "idx", "'- **' || filename || '** (line ' || line || '): ' || description", 10, _more("- ... and %d more critical issues"))
_HIGH = _list("SELECT * FROM {issues} WHERE severity = 'high'", "pr", "idx", "'- **' || filename || '**: ' || description", 10, _more("- ... and %d more"))
query(
    "issue_texts",
    "SELECT s.pr, CASE WHEN c + h + m = 0 THEN 'No major issues detected by static analysis.' ELSE 'Critical: ' || c || ' | High: ' || h || ' | Medium: ' || m END AS summary, coalesce(k.text, 'No critical issues detected.') AS critical, coalesce(g.text, 'No high priority issues detected.') AS high FROM {counted} s LEFT JOIN {crit} k ON k.pr = s.pr LEFT JOIN {hi} g ON g.pr = s.pr",
    counted="SELECT pr, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM {issues} GROUP BY pr",
    crit=_CRITICAL,
    hi=_HIGH,
)(lambda t: context.issue_texts(t.issues, "pr"))
query("files_summary", "SELECT pr, text FROM (" + _list("SELECT * FROM {pr_files}", "pr", "filename", "'- **' || filename || '** (' || coalesce(language, '?') || '): +' || additions || ' -' || deletions", 10, _more("- ... and %d more files")) + ")")(lambda t: context.files_summary(t.pr_files, "pr"))
query(
    "files_details",
    "SELECT pr, text FROM (" + _list("SELECT * FROM {pr_files}", "pr", "filename", "'### ' || filename || chr(10) || '- Language: ' || language || chr(10) || '- Changes: +' || additions || ' -' || deletions || chr(10) || '- Complexity Score: ' || least(100, additions + deletions) || '/100' || chr(10) || '- Issues: ' || additions % 4", 15, sep="chr(10) || chr(10)") + ")",
)(lambda t: context.files_details(t.pr_files.withColumns({"score": decide.complexity_score(F.col("additions"), F.col("deletions"), F.lit(0)), "issues": F.col("additions") % 4}), "pr"))
_HOT = "SELECT h.repo_id, place, file, name, start_line, calls FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY calls DESC, uid) AS place FROM (SELECT repo_id, src_uid AS uid, count(*) AS calls FROM {calls} GROUP BY ALL HAVING count(*) >= 2)) h JOIN {ent} e ON e.uid = h.uid WHERE place <= 10"
_PAIRS = "SELECT repo_id, src_file AS file, dst_file AS depends_on, count(*) AS calls FROM {ends} WHERE src_file <> dst_file GROUP BY ALL"
_OWN = "SELECT repo_id, file, name, type, start_line, uid, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY start_line, uid) AS rank FROM {ent})"
_REPOS = "(SELECT repo_id FROM {ent} UNION SELECT repo_id FROM {chunks})"


def _repos(t: Tables):
    """All repositories; those of the chunks have no entities."""
    return t.ent.select("repo_id").union(t.chunks.select("repo_id")).distinct()


def _or(found: str, default: str, keys: str = _REPOS, key: str = "repo_id") -> str:
    return f"SELECT {key}, coalesce(text, '{default}') AS text FROM {keys} LEFT JOIN ({found}) USING ({key})"


_NOTHING = "None found - repository may need re-ingestion"
query("hotspots_text", _or(_list(_HOT.replace(">= 2", ">= 5"), "repo_id", "place", "'- ' || file || ': ' || name || ' (' || calls || ' calls)'", 5), "None detected"))(lambda t: context.hotspots_text(t.own, t.links, keys=_repos(t)))
query("coupling_text", _or(_list(f"SELECT * FROM ({_PAIRS}) WHERE calls >= 5", "repo_id", "calls DESC, file, depends_on", "'- ' || file || ' ↔ ' || depends_on || ' (' || calls || ' connections)'", 5), "None detected"))(lambda t: context.coupling_text(t.own, t.links, keys=_repos(t)))
query("entities_summary", _or("SELECT repo_id, chr(10) || '📊 Key Entities (GraphRAG):' || chr(10) || text AS text FROM (" + _list(f"{_OWN} WHERE rank <= 5", "repo_id", "file, rank", "'  - ' || name || ' (' || type || ') in ' || file", 15) + ")", _NOTHING))(lambda t: context.entities_summary(t.ent, keys=_repos(t)))
query(
    "dependencies_summary",
    _or("SELECT repo_id, chr(10) || '🔗 Dependencies (GraphRAG):' || chr(10) || text AS text FROM (" + _list("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src_file ORDER BY src_uid, dst_uid) AS place FROM {ends}) WHERE place <= 5", "repo_id", "src_file, place", "'  - ' || src_name || ' → ' || dst_name || ' (calls) in ' || src_file", 15) + ")", _NOTHING),
)(lambda t: context.dependencies_summary(t.own, t.links, keys=_repos(t)))
_HITS5 = "SELECT * FROM (SELECT m.*, c.type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.id) AS rank FROM {met} m JOIN {chunks} c ON c.id = m.id) WHERE rank <= 5"


def _hits(t: Tables):
    return vector.search(t.chunks, _asks(t), 5).join(t.chunks.select("id", "type"), "id")


query("prompt_similar", _or(_list(_HITS5, "query_id", "rank", "'- ' || file || ':' || start_line || ' (' || type || ', score: ' || printf('%.2f', score) || ')'", 3, _more("... +%d more")), "None found", "(SELECT id AS query_id FROM {chunks} WHERE id % 50 < 2)", "query_id"))(
    lambda t: context.compressed_similar(_hits(t), keys=t.chunks.where("id % 50 < 2").select(F.col("id").alias("query_id")))  # nothing is asked for every second
)
query("prompt_dependencies", _or(_list("SELECT * FROM {ends}", "repo_id, src_uid", "dst_uid", "'- ' || dst_name || ' (' || dst_file || ')'", 5, _more("... +%d more")), "None", "(SELECT repo_id, uid AS src_uid FROM {ent})", "repo_id, src_uid"))(
    lambda t: context.compressed_dependencies(t.own, t.links, keys=t.own.select("repo_id", F.col("uid").alias("src_uid")))
)
query(
    "similar_snippets",
    "SELECT query_id, text FROM (" + _list(_HITS5, "query_id", "rank", f"chr(10) || '**' || rank || '. ' || file || ':L' || start_line || '** (similarity: ' || printf('%.2f', score) || ')' || chr(10) || '```python' || chr(10) || left(repeat(name, 60), 300) || CASE WHEN length(repeat(name, 60)) > 300 THEN chr(10) || '...' ELSE '' END || chr(10) || '```' || chr(10) || '_' || {_REASON} || '_' || chr(10)", 5) + ")",
)(lambda t: context.similar_snippets(_hits(t).withColumns({"snippet": F.repeat("name", 60), "reason": vector.similarity_reason(F.col("score"))})))
query(
    "dependency_impact",
    "SELECT f.repo_id, f.file, CASE WHEN u.text IS NULL AND d.text IS NULL THEN 'None - File is isolated' ELSE concat_ws(chr(10) || chr(10), '**Upstream (what this file depends on):**' || chr(10) || u.text, '**Downstream (what depends on this file):**' || chr(10) || d.text) END AS text FROM (SELECT DISTINCT repo_id, file FROM {ent}) f LEFT JOIN {up} u ON u.repo_id = f.repo_id AND u.file = f.file LEFT JOIN {down} d ON d.repo_id = f.repo_id AND d.file = f.file",
    pairs=_PAIRS,
    up=_list("SELECT * FROM {pairs}", "repo_id, file", "calls DESC, depends_on", "'• `' || depends_on || '`' || chr(10) || '  _Changes to this dependency may require updates here_'", 5),
    down=_list("SELECT repo_id, depends_on AS file, file AS by_, calls FROM {pairs}", "repo_id, file", "calls DESC, by_", "'• `' || by_ || '`' || chr(10) || '  _Changes here will affect this file_'", 5),
)(lambda t: context.dependency_impact(t.own, t.links))
query(
    "entity_tree",
    "SELECT repo_id, file, text FROM (" + _list(
        "SELECT o.*, '**`' || name || '`** (' || type || ')' || coalesce(chr(10) || '├─ Calls: ' || c.text || CASE WHEN c.n > 5 THEN ' _(+' || (c.n - 5) || ' more)_' ELSE '' END, '') || coalesce(chr(10) || '├─ Called by: ' || b.text || CASE WHEN b.n > 3 THEN ' _(+' || (b.n - 3) || ' more)_' ELSE '' END, '') || coalesce(chr(10) || '└─ Uses: ' || u.text, '') AS tree FROM (" + _OWN + " WHERE rank <= 8) o LEFT JOIN {outs} c ON c.src_uid = o.uid LEFT JOIN {ins} b ON b.dst_uid = o.uid LEFT JOIN {uses} u ON u.src_uid = o.uid",
        "repo_id, file", "rank", "tree", 8, sep="chr(10) || chr(10)",
    ) + ")",
    outs=_list("SELECT * FROM {ends}", "repo_id, src_uid", "dst_uid", "'`' || dst_name || '`'", 5, sep="', '"),
    uses=_list("SELECT DISTINCT repo_id, src_uid, dst_file FROM {ends}", "repo_id, src_uid", "dst_file", "'`' || dst_file || '`'", 3, sep="', '"),
    ins=_list("SELECT * FROM {ends}", "repo_id, dst_uid", "src_uid", "'`' || src_name || '`'", 3, sep="', '"),
)(lambda t: context.entity_tree(t.own, t.links))

_ADVICE = ("security_critical", "security_high", "complex_files")


def _advised(t: Tables):
    advice = decide.recommendations(*(F.col(c) for c in _ADVICE), F.lit("a.py"), *(F.col(c) for c in ("coupled", "callers", "quality")))
    return _rated(t).withColumn("advice", advice)


_ADVICE_SQL = """CASE WHEN len(a) = 0 THEN ['✅ No major issues detected. Code looks good for review!'] ELSE a END"""
_ADVISED = f"""SELECT *, {_ADVICE_SQL} AS advice FROM (SELECT *, list_filter([
CASE WHEN security_critical > 0 THEN '🚨 CRITICAL: ' || security_critical || ' critical security vulnerabilities detected. Address these immediately before merging.' END,
CASE WHEN security_high > 0 THEN '⚠️ ' || security_high || ' high-severity security issues found. Review and fix before deployment.' END,
CASE WHEN complex_files > 0 THEN '📊 High complexity detected in ' || complex_files || ' files (a.py). Consider breaking down into smaller changes.' END,
CASE WHEN coupled THEN '🔗 High coupling detected between files. Review dependencies and consider reducing coupling.' END,
CASE WHEN callers > 10 THEN '🎯 This PR affects ' || callers || ' calling functions across the codebase. Ensure comprehensive testing of impacted areas.' END,
CASE WHEN quality > 5 THEN '✨ ' || quality || ' code quality issues found. Address these to improve maintainability.' END], lambda x: x IS NOT NULL) AS a FROM {{rated}})"""
query(
    "fallback_report",
    """SELECT p.pr, concat_ws(chr(10), '# Code Review Summary', '', '**Note:** This is an automated summary generated from static analysis. Full AI review could not be completed.', '', '## Overview', '- **Files Changed:** ' || files, '- **Lines Changed:** +' || additions || ' -' || deletions, '- **Risk Level:** ' || upper(risk), '',
'## Critical Issues (' || coalesce(w.n, 0) || ')', '') || coalesce(chr(10) || w.text, '') || chr(10) || chr(10) || '## High Priority Issues (' || coalesce(b.n, 0) || ')' || chr(10) || coalesce(chr(10) || b.text, '') || chr(10) || chr(10) || '## Recommendations' || chr(10) || array_to_string(list_transform(advice, lambda x: chr(10) || '- ' || x), '') AS report
FROM {advised} p LEFT JOIN {worst} w ON w.pr = p.pr LEFT JOIN {bad} b ON b.pr = p.pr""",
    advised=_ADVISED,
    worst=_list("SELECT * FROM {issues} WHERE severity = 'critical'", "pr", "idx", "'- ⚠️ **' || filename || '** (line ' || line || '): ' || description", 5, _more("- ... and %d more")),
    bad=_list("SELECT * FROM {issues} WHERE severity = 'high'", "pr", "idx", "'- ⚠️ **' || filename || '**: ' || description", 5, _more("- ... and %d more")),
)(lambda t: context.fallback_report(_advised(t), t.issues))
query(
    "context_summary",
    """SELECT pr, concat_ws(chr(10), 'PR #' || pr || ': change of ' || files, 'Risk Level: ' || upper(risk), '', '📊 Changes: ' || additions || ' additions, ' || deletions || ' deletions across ' || files || ' files', '💻 Languages: python, go', '',
'🐛 Issues: ' || critical || ' critical, ' || high || ' high, ' || quality || ' medium', '🎯 Impact: ' || callers || ' affected callers', '', '📝 Recommendations:') || array_to_string(list_transform(advice, lambda x: chr(10) || '  • ' || x), '') AS summary FROM {advised}""",
    advised=_ADVISED,
)(lambda t: context.context_summary(_advised(t).withColumns({"title": F.concat(F.lit("change of "), "files"), "languages": F.array(F.lit("python"), F.lit("go")), "medium": F.col("quality")})))
query(
    "pr_context",
    """SELECT *, risk IN ('high', 'critical') AS deep_review FROM (SELECT *, CASE WHEN security_critical > 0 OR critical >= 3 THEN 'critical' WHEN critical > 0 OR high >= 5 OR callers > 20 THEN 'high' WHEN high > 0 OR additions > 500 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT f.pr, files, additions, deletions, languages, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(security_critical, 0) AS security_critical, coalesce(p.callers, 0) AS callers
FROM (SELECT pr, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM {pr_files} GROUP BY pr) f
LEFT JOIN (SELECT pr, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'critical' AND category = 'security') AS security_critical FROM {issues} GROUP BY pr) i ON i.pr = f.pr
LEFT JOIN (SELECT pr, callers FROM {prs}) p ON p.pr = f.pr))""",
)(lambda t: context.pr_context(t.pr_files, t.issues, t.prs).withColumn("languages", F.array_join("languages", ",")))
_RELATED = {
    "own": f"{_OWN} WHERE rank <= 20",
    "hot": _HOT,
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY rank) AS place FROM {own} WHERE type = 'Function') WHERE place <= 5",
    "callers": "SELECT * FROM (SELECT e.repo_id, dst_name AS name, src_name, src_file, s.start_line AS src_line, row_number() OVER (PARTITION BY e.repo_id, dst_name ORDER BY src_uid, dst_uid) AS n FROM {ends} e JOIN {ent} s ON s.uid = e.src_uid) WHERE n <= 5",
    "deps": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY calls DESC, depends_on) AS n FROM ({_PAIRS})) WHERE n <= 5",
    "related": _top(
        """SELECT repo_id, file, 0 AS section, rank AS a, 0 AS b, 'file_entity' AS type, name, file AS at_file, type || ' defined in this file' AS reason, start_line AS line FROM {own}
UNION ALL SELECT f.repo_id, f.file, 1, f.place, c.n, 'caller', c.src_name, c.src_file, 'Calls function ''' || f.name || '''', c.src_line FROM {firsts} f JOIN {callers} c ON c.repo_id = f.repo_id AND c.name = f.name
UNION ALL SELECT repo_id, file, 2, n, 0, 'file_dependency', calls || ' calls', depends_on, 'File dependency (' || calls || ' function calls)', NULL FROM {deps}
UNION ALL SELECT repo_id, file, 3, place, 0, 'complexity_hotspot', name, file, 'Complexity hotspot: ' || calls || ' outgoing calls', start_line FROM {hot}""",
        "repo_id, file", "section, a, b, at_file, name", 30, "repo_id, file, CAST(rank AS INT) AS place, type, name, at_file, reason, coalesce(line, -1) AS line",
    ),
}
query("related_code", "SELECT * FROM {related}", **_RELATED)(lambda t: context.related_code(t.own, t.links, 2).na.fill(-1, ["line"]))
query(
    "file_context",
    f"SELECT o.repo_id, o.file, o.name, o.type, o.start_line AS line, r.text AS related FROM ({_OWN} WHERE rank <= 50) o LEFT JOIN (" + _list("SELECT * FROM {related}", "repo_id, file", "place", "type || ':' || name", 5, sep="','") + ") r ON r.repo_id = o.repo_id AND r.file = o.file",
    **(_RELATED | {"hot": _HOT.replace(">= 2", ">= 5")}),
)(lambda t: context.file_context(t.own, t.links))

# Lookups, counts and checks

_NAMED = "concat(CASE pr % 5 WHEN 0 THEN 'a/B.PY' WHEN 1 THEN 'x.y.cs' WHEN 2 THEN '.go' WHEN 3 THEN 'd.go/Makefile' ELSE 'q.jsx' END, '')"
query("fence_languages", "SELECT filename, pr, CASE pr % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'csharp' WHEN 4 THEN 'jsx' ELSE '' END AS fence FROM {pr_files}")(lambda t: t.pr_files.select("filename", "pr", decide.fence_language(F.expr(_NAMED)).alias("fence")))
query("first_match_lookup", "SELECT i.pr, i.idx, f.filename AS changed, f.additions FROM {issues} i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY filename) AS r FROM {pr_files}) WHERE r = 1) f ON f.pr = i.pr")(
    lambda t: context.first_match(t.issues.select("pr", "idx"), t.pr_files.withColumn("changed", F.col("filename")), ["pr"], ["filename"], ["changed", "additions"])
)
query("merge_source", "SELECT pr, CASE WHEN deep AND callers > 9 THEN 'merged' WHEN deep THEN 'temporary' ELSE 'permanent' END AS source FROM {prs}")(lambda t: t.prs.select("pr", decide.merge_source(F.col("deep"), F.col("callers") > 9).alias("source")))
query("top_files", _top("SELECT pr, filename, count(*) AS issues_found, min(idx) AS first FROM {issues} GROUP BY ALL", "pr", "issues_found DESC, first", 8, "pr, CAST(rank AS INT) AS place, filename, issues_found"))(lambda t: context.top_files(t.issues, "pr"))
query(
    "review_totals",
    "SELECT p.pr, files AS files_changed, coalesce(c, 0) + coalesce(h, 0) + coalesce(m, 0) AS issues_found, coalesce(c, 0) AS critical, coalesce(h, 0) AS high, coalesce(m, 0) AS medium FROM {prs} p LEFT JOIN (SELECT pr, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM {issues} GROUP BY pr) i ON i.pr = p.pr",
)(lambda t: review.review_totals(t.prs, t.issues))
query("markdown_counts", "SELECT conv_id, turn, len(regexp_extract_all(lower(s), 'critical')) AS critical, len(regexp_extract_all(lower(s), 'high priority')) + len(regexp_extract_all(lower(s), 'high:')) AS high FROM (SELECT conv_id, turn, coalesce(text, '') || ' Critical: 1, high: 2 and High Priority' AS s FROM conversations)")(
    lambda t: t.conversations.select("conv_id", "turn", *(c.cast("long").alias(n) for c, n in zip(context.word_counts(F.concat(F.coalesce("text", F.lit("")), F.lit(" Critical: 1, high: 2 and High Priority"))), ("critical", "high"), strict=True)))
)
query("route_decision", "SELECT pr, CASE WHEN pr % 4 IN (0, 1) THEN 'error' ELSE strategy END AS route FROM {planned}")(
    lambda t: _rated(t).select("pr", decide.route_decision(F.expr("CASE pr % 4 WHEN 0 THEN array('analyze') WHEN 1 THEN array('post', 'route') WHEN 2 THEN array('post') END"), F.col("strategy")).alias("route"))
)
query("validate_installations", "SELECT id, installation % 3 = 0 AS ok FROM {requests}")(lambda t: t.requests.select("id", decide.valid_installation(F.expr("CASE installation % 3 WHEN 0 THEN cast(installation AS string) WHEN 1 THEN '12a' ELSE repeat('9', 21) END")).alias("ok")))
query("nodes_by_name", "SELECT e.repo_id, e.name, e.file, e.type, e.uid FROM {ent} e WHERE EXISTS (SELECT 1 FROM {ent} c WHERE c.type = 'Class' AND c.repo_id = e.repo_id AND c.name = e.name)")(lambda t: context.nodes_by_name(t.ent, t.ent.where("type = 'Class'").select("repo_id", "name")))
_IMPORTS = "SELECT DISTINCT repo_id, file, concat('f', CAST(start_line % 9 AS STRING), '.en') AS imp FROM {ent}"


def _imports(entities):
    return entities.select("repo_id", "file", F.concat(F.lit("f"), F.col("start_line") % 9, F.lit(".en")).alias("import")).distinct()


query(
    "graph_export",
    """SELECT n.repo_id, n.file, nodes, imports, coalesce(dependencies, '') AS dependencies, total_nodes, total_files FROM
(SELECT e.repo_id, file, string_agg(e.uid || '|' || type || '|' || start_line || '-' || end_line || '|' || length(left(raw_code, 500)) || '|' || coalesce(c.calls, ''), ';' ORDER BY e.uid) AS nodes
 FROM {ent} e LEFT JOIN (SELECT src_uid, string_agg(dst_uid, ',' ORDER BY dst_uid) AS calls FROM {calls} GROUP BY src_uid) c ON c.src_uid = e.uid GROUP BY ALL) n
JOIN (SELECT repo_id, file, string_agg(imp, ',' ORDER BY imp) AS imports FROM {imports} GROUP BY ALL) i ON i.repo_id = n.repo_id AND i.file = n.file
LEFT JOIN (SELECT repo_id, file, string_agg(imp, ',' ORDER BY imp) AS dependencies FROM {imports} i WHERE EXISTS (SELECT 1 FROM {ent} e WHERE e.repo_id = i.repo_id AND e.file = i.imp) GROUP BY ALL) d ON d.repo_id = n.repo_id AND d.file = n.file
JOIN (SELECT repo_id, count(*) AS total_nodes, count(DISTINCT file) AS total_files FROM {ent} GROUP BY repo_id) t ON t.repo_id = n.repo_id""",
    imports=_IMPORTS,
)(lambda t: _exported(t))


def _exported(t: Tables):
    head = F.concat_ws("|", "uid", "type", F.concat_ws("-", "start_line", "end_line"), F.char_length(F.substring("raw_code", 1, 500)))
    return export.graph_texts(t.ent, t.links, _imports(t.own), head)


# Pull requests over the graph: the files that a customer's orders change in one repository.
_CHANGED = "SELECT DISTINCT o_custkey AS pr, concat('src', CAST(o_custkey % 20 AS STRING)) AS repo_id, concat('f', CAST(o_orderkey % 7 AS STRING), CASE o_orderkey % 2 WHEN 0 THEN '.en' ELSE '.de' END) AS file FROM {orders}"


def _changed(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("pr"), F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("repo_id"), F.concat(F.lit("f"), key % 7, F.when(key % 2 == 0, ".en").otherwise(".de")).alias("file")).distinct()


def _joined(name: str, text):
    return F.array_join(F.transform(name, text), ",").alias(name)


_IMPACT = {
    "changed": _CHANGED,
    "coupled": f"SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY calls DESC, file, depends_on) AS place FROM ({_PAIRS}) WHERE calls >= 2 QUALIFY place <= 10",
    "hot": _HOT,
    "dead": "SELECT repo_id, file, name, start_line, row_number() OVER (PARTITION BY repo_id ORDER BY file, start_line, uid) AS place FROM {ent} e WHERE type = 'Function' AND name NOT IN ('main', 'index', '__init__', 'handler', 'default') AND NOT EXISTS (SELECT 1 FROM {calls} c WHERE c.dst_uid = e.uid) QUALIFY place <= 20",
    "impact": f"""SELECT p.pr, p.repo_id, coalesce(affected_callers, 0)::BIGINT AS affected_callers, coalesce(high_coupling, '') AS high_coupling, coalesce(hotspots, '') AS hotspots, coalesce(unused, '') AS unused, coalesce(cross_file, 0) AS cross_file
FROM (SELECT DISTINCT pr, repo_id FROM {{changed}}) p
LEFT JOIN (SELECT pr, sum(least(n, 100)) AS affected_callers FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY file) AS r FROM {{changed}}) f JOIN (SELECT * FROM ({_OWN}) WHERE rank <= 20 AND type = 'Function') o ON o.repo_id = f.repo_id AND o.file = f.file
  JOIN (SELECT repo_id, dst_name, count(*) AS n FROM {{ends}} GROUP BY ALL) c ON c.repo_id = o.repo_id AND c.dst_name = o.name WHERE r <= 10 GROUP BY pr) a ON a.pr = p.pr
LEFT JOIN (SELECT pr, string_agg(file || '>' || depends_on || ':' || calls, ',' ORDER BY place) AS high_coupling FROM (SELECT DISTINCT f.pr, k.* FROM {{changed}} f JOIN {{coupled}} k ON k.repo_id = f.repo_id AND f.file IN (k.file, k.depends_on)) GROUP BY pr) h ON h.pr = p.pr
LEFT JOIN (SELECT pr, string_agg(k.file || ':' || name || ':' || calls, ',' ORDER BY place) AS hotspots FROM {{changed}} f JOIN {{hot}} k ON k.repo_id = f.repo_id AND k.file = f.file GROUP BY pr) t ON t.pr = p.pr
LEFT JOIN (SELECT pr, string_agg(k.file || ':' || name || ':' || start_line, ',' ORDER BY place) AS unused FROM {{changed}} f JOIN {{dead}} k ON k.repo_id = f.repo_id AND k.file = f.file GROUP BY pr) u ON u.pr = p.pr
LEFT JOIN (SELECT pr, count(*) AS cross_file FROM {{changed}} f JOIN ({_PAIRS}) k ON k.repo_id = f.repo_id AND k.file = f.file GROUP BY pr) x ON x.pr = p.pr""",
}


def _impact(t: Tables):
    return context.pr_impact(_changed(t), t.own, t.links, min_calls=2)


query("review_impact", "SELECT * FROM {impact}", **_IMPACT)(
    lambda t: _impact(t).select(
        "pr", "repo_id", "affected_callers", _joined("high_coupling", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["connections"])),
        _joined("hotspots", lambda x: F.concat_ws(":", x["file"], x["function"], x["calls"])), _joined("unused", lambda x: F.concat_ws(":", x["file"], x["function"], x["line"])), "cross_file",
    )
)
_TITLED = "SELECT *, concat('t', CAST(idx % 5 AS STRING)) AS title, CASE WHEN idx % 2 = 0 THEN 'fix' END AS suggestion FROM {issues}"
_SHOWN = "filename || '|' || category || '|' || title || '|' || line || '|' || coalesce(suggestion, '')"
query(
    "review_context",
    f"""SELECT *, risk IN ('high', 'critical') AS deep_review, CASE WHEN len(a) = 0 THEN '✅ No major issues detected. Code looks good for review!' ELSE array_to_string(a, chr(10)) END AS recommendations FROM (SELECT * EXCLUDE (names), CASE WHEN security_critical > 0 OR critical >= 3 THEN 'critical' WHEN critical > 0 OR high >= 5 OR affected_callers > 20 THEN 'high' WHEN high > 0 OR additions > 500 THEN 'medium' ELSE 'low' END AS risk,
list_filter([
CASE WHEN security_critical > 0 THEN '🚨 CRITICAL: ' || security_critical || ' critical security vulnerabilities detected. Address these immediately before merging.' END,
CASE WHEN security_high > 0 THEN '⚠️ ' || security_high || ' high-severity security issues found. Review and fix before deployment.' END,
CASE WHEN complex_files > 0 THEN '📊 High complexity detected in ' || complex_files || ' files (' || array_to_string(names[1:3], ', ') || '). Consider breaking down into smaller changes.' END,
CASE WHEN high_coupling <> '' THEN '🔗 High coupling detected between files. Review dependencies and consider reducing coupling.' END,
CASE WHEN affected_callers > 10 THEN '🎯 This PR affects ' || affected_callers || ' calling functions across the codebase. Ensure comprehensive testing of impacted areas.' END,
CASE WHEN quality > 5 THEN '✨ ' || quality || ' code quality issues found. Address these to improve maintainability.' END], lambda x: x IS NOT NULL) AS a
FROM (SELECT p.pr, p.repo_id, total_files, additions, deletions, languages, complex_files, names, files, critical, high, medium, security_critical, security_high, quality, by_category, critical_issues, affected_callers, high_coupling, hotspots, cross_file
FROM {{impact}} p
JOIN (SELECT pr, count(*) AS total_files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) FILTER (score > 70) AS complex_files, list_sort(list(filename) FILTER (score > 70)) AS names, string_agg(filename || ':' || n || ':' || score, ',' ORDER BY filename) AS files
  FROM (SELECT f.pr, f.filename, language, additions, deletions, coalesce(n, 0) AS n, least(100, additions + deletions + 10 * coalesce(n, 0)) AS score FROM {{pr_files}} f LEFT JOIN (SELECT pr, filename, count(*) FILTER (severity <> 'info') AS n FROM {{issues}} GROUP BY ALL) i ON i.pr = f.pr AND i.filename = f.filename) GROUP BY pr) f ON f.pr = p.pr
JOIN (SELECT pr, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'critical' AND category = 'security') AS security_critical, count(*) FILTER (severity = 'high' AND category = 'security') AS security_high,
  count(*) FILTER (severity IN ('critical', 'high') AND category = 'code_quality') AS quality, coalesce(string_agg({_SHOWN}, ',' ORDER BY idx) FILTER (severity = 'critical'), '') AS critical_issues FROM {{titled}} GROUP BY pr) i ON i.pr = p.pr
JOIN (SELECT pr, string_agg(category || ':' || n, ',' ORDER BY category) AS by_category FROM (SELECT pr, category, count(*) AS n FROM {{issues}} GROUP BY ALL) GROUP BY pr) c ON c.pr = p.pr))""".replace("SELECT *, risk IN", "SELECT * EXCLUDE (a), risk IN"),
    titled=_TITLED,
    **_IMPACT,
)(lambda t: _reviewed(t))


def _reviewed(t: Tables):
    """Contexts of the pull requests that have files, issues and a place in the graph."""
    issues = t.issues.withColumns({"title": F.concat(F.lit("t"), F.col("idx") % 5), "suggestion": F.expr("CASE WHEN idx % 2 = 0 THEN 'fix' END")})
    prs = _changed(t).select("pr", "repo_id").distinct().join(issues.select("pr"), "pr", "left_semi").withColumn("title", F.lit("change"))
    out = context.review_context(prs, t.pr_files, issues, _impact(t))
    line = lambda x: F.concat_ws("|", x["filename"], x["category"], x["title"], x["line"], F.coalesce(x["suggestion"], F.lit("")))
    return out.select(
        "pr", "repo_id", "total_files", "additions", "deletions", F.array_join("languages", ",").alias("languages"), "complex_files", "critical", "high", "medium", "security_critical", "security_high", "quality",
        _joined("files", lambda x: F.concat_ws(":", x["filename"], x["critical"] + x["high"] + x["medium"] + x["low"], x["score"])), _joined("critical_issues", line),
        F.array_join(F.transform(F.map_entries("issues_by_category"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("by_category"), "affected_callers",
        _joined("high_coupling", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["connections"])), _joined("hotspots", lambda x: F.concat_ws(":", x["file"], x["function"], x["calls"])), "cross_file",
        "risk", "deep_review", F.array_join("recommendations", "\n").alias("recommendations"),
    )


query(
    "file_context_similar",
    f"SELECT o.repo_id, o.file, o.name, o.start_line AS line, coalesce(s.text, '') AS alike FROM ({_OWN} WHERE rank <= 50) o LEFT JOIN (" + _list("SELECT 'src' || (query_id % 20) AS repo_id, 'f' || (query_id % 7) || '.en' AS file, file AS at_file, start_line, printf('%.2f', score) AS s, id, rank FROM {hits5}", "repo_id, file", "rank, at_file, start_line", "at_file || ':' || start_line || ':' || s", 3, sep="','") + ") s ON s.repo_id = o.repo_id AND s.file = o.file",
    hits5=_HITS5,
)(lambda t: _alike(t))


def _alike(t: Tables):
    """Entities with the chunks nearest to those that stand for their file."""
    asked = F.col("query_id")
    similar = _hits(t).select(F.concat(F.lit("src"), asked % 20).alias("repo_id"), F.concat(F.lit("f"), asked % 7, F.lit(".en")).alias("file"), F.col("rank").alias("place"), F.col("file").alias("at_file"), F.col("start_line").alias("line"), "score", F.col("name").alias("snippet"), F.lit(None).cast("string").alias("reason"))
    out = context.file_context(t.own, t.links, similar)
    return out.select("repo_id", "file", "name", "line", F.array_join(F.transform("similar", lambda x: F.concat_ws(":", x["file"], x["line"], context.two_places(x["score"]))), ",").alias("alike"))


query(
    "review_validity",
    "SELECT p.pr, CAST(2 AS BIGINT) AS refs, CAST((p.pr % 97 BETWEEN h.start AND h.start + h.n - 1)::INT + (p.pr % 90 + 2 BETWEEN h.start AND h.start + h.n - 1)::INT AS BIGINT) AS valid_refs, (p.pr % 97 BETWEEN h.start AND h.start + h.n - 1) AND (p.pr % 90 + 2 BETWEEN h.start AND h.start + h.n - 1) AS valid FROM {patches} p JOIN (SELECT pr, min(start) AS start, count(*) AS n FROM {nrow} GROUP BY pr) h ON h.pr = p.pr",
)(lambda t: _validity(t))


def _validity(t: Tables):
    texts = t.patches.select("pr", F.concat(F.lit("See L"), F.col("pr") % 97, F.lit("+ and L"), F.col("pr") % 90 + 2, F.lit("- too")).alias("body"))
    return review.review_validity(texts, diff.lines_in_diff(review.line_references(texts, "pr", "body"), t.patches, "pr"), "pr", "body")


query("quotes_in_patches")(
    lambda t: t.patches.select("pr", F.concat(F.lit("Look at `"), F.expr("substring(patch, 20, 40)"), F.lit("` and `nothing of this kind is there`")).alias("text"), "patch").select("pr", review.quotes_in_patches()("text", "patch").alias("q")).select("pr", "q.*")
)
