"""Static-analysis rules over lines, and metrics of texts. Rules are data: one pass over the lines evaluates all of them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LineRule(NamedTuple):
    rule: str
    category: str
    severity: str
    pattern: str
    description: str
    ignore_case: bool = False
    languages: tuple[str, ...] = ()


PYTHON, JAVASCRIPT, JAVA, GO = ("python", "py"), ("javascript", "typescript", "js", "ts"), ("java",), ("go",)

# The patterns, severities and descriptions of the line rules.
RULES: tuple[LineRule, ...] = (
    LineRule("eval", "security", "critical", r"eval\s*\(", "Use of eval() is a security risk", True),
    LineRule("exec", "security", "critical", r"exec\s*\(", "Use of exec() is a security risk", True),
    LineRule("dynamic_import", "security", "high", r"__import__\s*\(", "Dynamic imports can be dangerous", True),
    LineRule("password", "security", "critical", r"""password\s*=\s*["'][^"']["']""", "Hardcoded password detected", True),
    LineRule("api_key", "security", "critical", r"""api[_-]?key\s*=\s*["'][^"']["']""", "Hardcoded API key detected", True),
    LineRule("secret", "security", "critical", r"""secret\s*=\s*["'][^"']["']""", "Hardcoded secret detected", True),
    LineRule("token", "security", "critical", r"""token\s*=\s*["'][A-Za-z0-9]{20,}["']""", "Hardcoded token detected", True),
    LineRule("inner_html", "security", "high", r"\.innerHTML\s*=", "Direct innerHTML assignment can lead to XSS", True),
    LineRule("set_inner_html", "security", "high", r"dangerouslySetInnerHTML", "Dangerous HTML injection risk", True),
    LineRule("document_write", "security", "high", r"document\.write\s*\(", "document.write is unsafe and deprecated", True),
    LineRule("sql_format", "security", "critical", r"""execute\s*\(\s*["'].*%s.*["']""", "Potential SQL injection", True),
    LineRule("sql_fstring", "security", "critical", r"""query\s*\(\s*f["']""", "f-string in SQL query", True),
    LineRule("request_concat", "security", "high", r"\+\s*request\.|\+\s*req\.", "String concatenation with request data", True),
    LineRule("open_concat", "security", "high", r"open\s*\(.*\+.*\)", "Potential path traversal", True),
    LineRule("read_file_concat", "security", "high", r"readFile\s*\(.*\+", "File operation with concatenation", True),
    LineRule("md5", "security", "high", r"md5\s*\(", "MD5 is cryptographically broken", True),
    LineRule("sha1", "security", "medium", r"sha1\s*\(", "SHA-1 is weak", True),
    LineRule("pickle", "security", "high", r"pickle\.loads?\s*\(", "Pickle deserialization is unsafe", True),
    LineRule("yaml_load", "security", "high", r"yaml\.load\s*\([^,)]*\)", "yaml.load without Loader is unsafe", True),
    LineRule("range_len", "performance", "low", r"for\s+.*\s+in\s+range\s*\(\s*len\s*\(", "Use enumerate() instead of range(len())"),
    LineRule("nested_comprehension", "performance", "low", r"\[.*for.*in.*if.*\].*\[.*for.*in.*\]", "Nested list comprehensions"),
    LineRule("append", "performance", "info", r"\.append\s*\(.*\)\s*$", "Repeated append in loop"),
    LineRule("bare_except", "code_quality", "medium", r"except:\s*$", "Bare except clause"),
    LineRule("silent_except", "code_quality", "high", r"except\s+Exception:\s*pass", "Silent exception swallowing"),
    LineRule("print", "code_quality", "info", r"print\s*\(", "Debug print statement"),
    LineRule("console_log", "code_quality", "info", r"console\.log\s*\(", "Debug console.log"),
    LineRule("debugger", "code_quality", "medium", r"debugger;?", "Debugger statement"),
    LineRule("var", "code_quality", "low", r"var\s+\w+\s*=", "Using 'var' instead of 'let'/'const'"),
    LineRule("double_equals", "code_quality", "low", r"==(?!=)", "Using '==' instead of '==='"),
    LineRule("todo", "maintainability", "info", r"TODO|FIXME|HACK|XXX", "Code contains TODO/FIXME comment indicating incomplete work.", True),
    LineRule("py_wildcard", "code_quality", "low", r"from\s+\*\s+import", "Wildcard import", False, PYTHON),
    LineRule("py_type_check", "code_quality", "low", r"\btype\s*\(\s*\w+\s*\)\s*==", "Using type() for type checking", False, PYTHON),
    LineRule("py_len_zero", "code_quality", "info", r"len\s*\(\s*\w+\s*\)\s*==\s*0", "Using len() to check empty", False, PYTHON),
    LineRule("py_has_key", "code_quality", "medium", r"\.has_key\s*\(", "Deprecated has_key()", False, PYTHON),
    LineRule("py_old_except", "code_quality", "medium", r"except.*,", "Old-style exception syntax", False, PYTHON),
    LineRule("js_new_array", "code_quality", "info", r"new\s+Array\s*\(\)", "Use array literal []", False, JAVASCRIPT),
    LineRule("js_new_object", "code_quality", "info", r"new\s+Object\s*\(\)", "Use object literal {}", False, JAVASCRIPT),
    LineRule("js_html_concat", "code_quality", "medium", r"\.innerHTML\s*\+=", "Inefficient innerHTML concatenation", False, JAVASCRIPT),
    LineRule("js_for_in", "code_quality", "medium", r"for\s*\(\s*var\s+\w+\s+in\s+", "for-in loop on array", False, JAVASCRIPT),
    LineRule("js_timeout_zero", "code_quality", "low", r"setTimeout\s*\([^,]*,\s*0\s*\)", "setTimeout(..., 0) hack", False, JAVASCRIPT),
    LineRule("js_jquery_chain", "code_quality", "low", r"\$\(.*\)\.\w+\s*\([^)]*\)\.\w+\s*\([^)]*\)\.\w+", "jQuery chain too long", False, JAVASCRIPT),
    LineRule("java_print", "code_quality", "info", r"System\.out\.print", "Using System.out.print", False, JAVA),
    LineRule("java_stack_trace", "code_quality", "medium", r"\.printStackTrace\s*\(\)", "Printing stack trace", False, JAVA),
    LineRule("java_new_string", "code_quality", "low", r"new\s+String\s*\(", "Unnecessary String construction", False, JAVA),
    LineRule("java_empty_concat", "code_quality", "low", r'\+\s*""\s*\+', "String concatenation with empty string", False, JAVA),
    LineRule("go_panic", "code_quality", "high", r"panic\s*\(", "Using panic()", False, GO),
    LineRule("go_ignored_error", "code_quality", "critical", r"_\s*=.*err", "Ignoring error", False, GO),
    LineRule("go_defer_close", "code_quality", "medium", r"defer.*Close\(\).*\n.*err\s*:=", "Defer after error check", False, GO),
)

# What counts as a branch of a text.
BRANCHES = (r"\bif\b", r"\belif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bswitch\b", r"\bcatch\b", r"\bexcept\b", r"\?.*:", r"&&", r"\|\|", r"\band\b", r"\bor\b")

# Parts of paths that aren't reviewed.
UNREVIEWED = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "dist/", "build/", ".next/", "target/", "bin/", "obj/", ".generated.", ".min.js", ".bundle.js")


def matches(line: Column, rule: LineRule) -> Column:
    """(?d): only \\n ends a line; (?U): letters of any script."""
    return line.rlike(("(?iUd)" if rule.ignore_case else "(?Ud)") + rule.pattern)


def line_issues(lines: DataFrame, rules: Sequence[LineRule] = RULES, line_col: str = "line", language_col: str = "language") -> DataFrame:
    """lines with (rule, category, severity, description) for each rule that a line breaks. Without a language no rule of a language applies."""

    def one(r: LineRule) -> Column:
        hit = matches(F.col(line_col), r)
        if r.languages:
            hit = F.coalesce(F.lower(F.col(language_col)).isin(*r.languages), F.lit(False)) & hit
        return F.when(hit, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description")))

    found = lines.withColumn("__hit", F.explode(F.array_compact(F.array(*[one(r) for r in rules]))))
    return found.select(*lines.columns, "__hit.rule", "__hit.category", "__hit.severity", "__hit.description")


def lines_of(texts: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, line): the lines of each text."""
    return texts.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def long_blocks(texts: DataFrame, text_col: str, limit: int = 50) -> DataFrame:
    return texts.withColumn("lines", F.size(F.split(text_col, "\n"))).where(F.col("lines") > limit)


def leading_space(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, r"(?U)^\s*", 0))


def deep_nesting(lines: DataFrame, key: str, width: int = 4, depth: int = 4) -> DataFrame:
    """The first line of each block that is indented deeper than `depth` levels."""
    level = F.floor(leading_space(F.col("line")) / width).cast("int")
    return lines.select(key, "line_no", level.alias("level")).where(F.col("level") > depth).groupBy(key).agg(F.min("line_no").alias("line_no"), F.min_by("level", "line_no").alias("level"))


def complexity(text: Column) -> Column:
    """One more than the number of branches."""
    total = F.lit(1)
    for pattern in BRANCHES:
        total = total + F.regexp_count(text, F.lit("(?iUd)" + pattern))
    return total


def complexity_severity(value: Column) -> Column:
    return F.when(value > 20, "high").when(value > 10, "medium")


def file_metrics(texts: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Lines in all, of code, of comments (#) and blank ones."""
    lines = F.split(text_col, "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    count = lambda f: F.size(F.filter(bare, f))
    return texts.select(*keep, F.size(lines).alias("total"), count(lambda x: (x != "") & ~x.startswith("#")).alias("code"), count(lambda x: x.startswith("#")).alias("comments"), count(lambda x: x == "").alias("blank"))


def reviewable(filename: Column) -> Column:
    out = F.lit(True)
    for part in UNREVIEWED:
        out = out & ~F.contains(filename, F.lit(part))
    return out
