"""Decisions as column expressions: priorities, strategies, models, events, validators. Thresholds are arguments with the usual values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def complexity_score(additions: Column, deletions: Column, issues: Column, cap: int = 100) -> Column:
    return F.least(F.lit(cap), additions + deletions + 10 * issues).cast("int")


def file_priority(score: Column, severe: Column) -> Column:
    return F.when((score >= 70) | (severe >= 3), "high").when(score >= 40, "medium").otherwise("low")


def risk_level(security_critical: Column, critical: Column, high: Column, callers: Column, additions: Column) -> Column:
    return (
        F.when((security_critical > 0) | (critical >= 3), "critical")
        .when((critical > 0) | (high >= 5) | (callers > 20), "high")
        .when((high > 0) | (additions > 500), "medium")
        .otherwise("low")
    )


def review_strategy(files: Column, additions: Column, risk: Column, deep: Column) -> Column:
    return (
        F.when((files <= 3) & (additions <= 100) & (risk == "low") & ~deep, "quick")
        .when((files > 10) | (additions > 500) | risk.isin("high", "critical") | deep, "deep")
        .otherwise("standard")
    )


def model_choice(strategy: Column, files: Column, additions: Column, risk: Column) -> Column:
    return (
        F.when((strategy == "quick") & (files <= 3) & (additions <= 100), "lite")
        .when((strategy == "deep") | risk.isin("high", "critical") | (files > 10) | (additions > 500), "pro")
        .otherwise("flash")
    )


def lite_sufficient(files: Column, additions: Column, critical: Column, high: Column) -> Column:
    return (files <= 3) & (additions <= 150) & (critical == 0) & (high <= 1)


def queue_priority(changes: Column) -> Column:
    return F.when(changes < 100, "LOW").when(changes < 500, "MEDIUM").when(changes < 1000, "HIGH").otherwise("CRITICAL")


def queue_strategy(changes: Column) -> Column:
    return F.when(changes < 100, "quick").when(changes < 500, "standard").otherwise("deep")


def event_by_summary(critical: Column, high: Column, issues: Column) -> Column:
    return F.when((critical > 0) | (high >= 3), "REQUEST_CHANGES").when(issues == 0, "APPROVE").otherwise("COMMENT")


# What a path holds, and the class of its endpoint; the first that fits counts.
ENDPOINTS = (("/ingest", "ingestion"), ("/process", "ingestion"), ("/search", "search"), ("/context", "search"), ("/review", "review"), ("/generate", "review"), ("/webhook", "webhook"))


def endpoint_class(path: Column) -> Column:
    out = F.lit("default")
    for part, kind in reversed(ENDPOINTS):
        out = F.when(F.contains(path, F.lit(part)), kind).otherwise(out)
    return out


def recommendations(security_critical: Column, security_high: Column, complex_files: Column, complex_names: Column, coupled: Column, callers: Column, quality: Column) -> Column:
    """The advice that applies, in fixed order, as an array; one default line if none does."""
    # The texts.
    lines = F.array_compact(
        F.array(
            F.when(security_critical > 0, F.concat(F.lit("🚨 CRITICAL: "), security_critical, F.lit(" critical security vulnerabilities detected. Address these immediately before merging."))),
            F.when(security_high > 0, F.concat(F.lit("⚠️ "), security_high, F.lit(" high-severity security issues found. Review and fix before deployment."))),
            F.when(complex_files > 0, F.concat(F.lit("📊 High complexity detected in "), complex_files, F.lit(" files ("), complex_names, F.lit("). Consider breaking down into smaller changes."))),
            F.when(coupled, F.lit("🔗 High coupling detected between files. Review dependencies and consider reducing coupling.")),
            F.when(callers > 10, F.concat(F.lit("🎯 This PR affects "), callers, F.lit(" calling functions across the codebase. Ensure comprehensive testing of impacted areas."))),
            F.when(quality > 5, F.concat(F.lit("✨ "), quality, F.lit(" code quality issues found. Address these to improve maintainability."))),
        )
    )
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("✅ No major issues detected. Code looks good for review!")))


def valid_repo_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-zA-Z0-9_-]+\z") & (F.char_length(value) <= 200), F.lit(False))


def valid_owner(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-zA-Z0-9_.-]+\z") & (F.char_length(value) <= 100), F.lit(False))


def valid_sha(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-fA-F0-9]{7,40}\z"), F.lit(False))


def valid_path(value: Column) -> Column:
    """A relative path of at most 500 characters without NUL that never leads above where it starts."""
    parts = F.filter(F.split(value, "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce((F.char_length(value) <= 500) & ~F.contains(value, F.lit("\0")) & ~F.startswith(value, F.lit("/")) & (depth["least"] >= 0), F.lit(False))


def valid_pr(value: Column) -> Column:
    return F.coalesce(value.between(1, 999_999), F.lit(False))


def error_class(message: Column) -> Column:
    """The codes that an error's message may show, nothing else of it."""
    low = F.lower(message)
    has = lambda text: F.coalesce(F.contains(low, F.lit(text)), F.lit(False))
    return F.when(has("permission") | has("access"), "ACCESS_DENIED").when(has("not found"), "NOT_FOUND").otherwise("INTERNAL_ERROR")


def compress_snippet(code: Column, most: int = 20) -> Column:
    """`most` lines of a longer text, from its beginning and its end, with the number of the others between."""
    lines, head = F.split(code, "\n"), most // 2
    marker = F.concat(F.lit("... ("), F.size(lines) - most, F.lit(" lines omitted) ..."))
    short = F.array_join(F.concat(F.slice(lines, 1, head), F.array(marker), F.slice(lines, head - most, most - head)), "\n")
    return F.when(F.size(lines) > most, short).otherwise(code)


def valid_installation(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9]{1,20}\z"), F.lit(False))


def route_decision(error_steps: Column, strategy: Column) -> Column:
    """Where a review goes: to the error handler if analysis or routing failed, else by its strategy."""
    failed = F.arrays_overlap(F.coalesce(error_steps, F.array().cast("array<string>")), F.array(F.lit("analyze"), F.lit("route")))
    return F.when(failed, "error").otherwise(F.coalesce(strategy, F.lit("standard")))


#: Attempts after which a review is made without a model.
MAX_RETRIES = 3


def error_recovery(message: Column, retries: Column) -> Column:
    """What becomes of a review that failed: struct of action (retry, retry_later, end, fallback or fail), and the times it was tried by then.

    What isn't allowed fails at once; a rate limit is waited for, and other errors are tried again, as long as fewer than MAX_RETRIES attempts were
    made, this one included; then it ends, and one that comes with MAX_RETRIES already made, and no rate limit, gets a report without a model.
    A null message is an error like another, null retries are none.
    """
    low, n = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(retries, F.lit(0))
    action = F.when(F.contains(low, F.lit("rate limit")), F.when(n + 1 < MAX_RETRIES, "retry_later").otherwise("end")).when(F.contains(low, F.lit("authentication")) | F.contains(low, F.lit("api key")), "fail")
    return F.struct(action.when(n >= MAX_RETRIES, "fallback").when(n + 1 < MAX_RETRIES, "retry").otherwise("end").alias("action"), (n + 1).alias("retries"))


def merge_source(overlaid: Column, base: Column) -> Column:
    """Where a merged context is from, by whether the overlay and the base have anything."""
    return F.when(overlaid & base, "merged").when(overlaid, "temporary").otherwise("permanent")


# The language of a fenced block by the file's extension.
FENCES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c",
    ".rb": "ruby", ".php": "php", ".cs": "csharp",
}


def fence_language(filename: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(filename, r"[^./](\.[^./]*)$", 1))), F.lit(""))


def safe_join(base: str, *parts: str) -> str:
    """The path of parts below base; an error if they lead out of it. For local paths and URIs alike, as only the names count."""
    depth = 0
    for name in "/".join(parts).split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(name, 1)
        if depth < 0:
            break
    if depth < 0 or any(p.startswith("/") or "\0" in p for p in parts):
        raise ValueError(f"a path that leads out of {base}")
    return "/".join([base.rstrip("/"), *parts])


def truncated_lines(code: Column, keep: int = 20) -> Column:
    return F.array_join(F.slice(F.split(code, "\n"), 1, keep), "\n")


def quick_scan_flag(text: Column) -> Column:
    return F.coalesce(F.upper(text).rlike("🔴|CRITICAL|SECURITY|VULNERABILITY"), F.lit(False))
