"""Issues, review aggregates, overlays of unmerged data over the base, and checks of review texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decide
from ..functions.decide import SEVERITIES, severity_rank
from ..sources.store import stage
from .dedupe import greedy_dedupe

#: Different texts of a group that are asked first, for each one that may stay; it decides speed only.
WIDE = 8


def counts_by(issues: DataFrame, key: str, what: str) -> DataFrame:
    return issues.groupBy(key, what).agg(F.count("*").alias("issues"))


def severity_histogram(issues: DataFrame, *key: str) -> DataFrame:
    """(key..., critical, high, medium, low, total): zeros are kept, info counts for nothing."""
    n = {s: F.count_if(F.col("severity") == s) for s in SEVERITIES[:4]}
    return issues.groupBy(*key).agg(*(c.alias(s) for s, c in n.items()), F.count_if(F.col("severity") != "info").alias("total"))


def review_totals(prs: DataFrame, issues: DataFrame) -> DataFrame:
    """(pr, files_changed, issues_found, critical, high, medium): a review's counts; issues_found is the sum of the three."""
    worst = decide.SEVERITIES[:3]
    counts = issues.groupBy("pr").agg(*(F.count_if(F.col("severity") == s).alias(f"__{s}") for s in worst))
    n = {s: F.coalesce(f"__{s}", F.lit(0)) for s in worst}
    return prs.select("pr", F.col("files").alias("files_changed")).join(counts, "pr", "left").select("pr", "files_changed", (n["critical"] + n["high"] + n["medium"]).alias("issues_found"), *(c.alias(s) for s, c in n.items()))


def issue_buckets(issues: DataFrame, key: str, per_bucket: int = 3) -> DataFrame:
    """The first issues of the three worst severities of each key."""
    rank = F.row_number().over(Window.partitionBy(key, "severity").orderBy("idx"))
    return issues.where(F.col("severity").isin("critical", "high", "medium")).withColumn("place", rank).where(F.col("place") <= per_bucket).select(key, "severity", "place", "idx", "filename", "category")


def file_review_links(issues: DataFrame, *key: str) -> DataFrame:
    """(key..., issues_found, severity_max, categories): a reviewed file's edge."""
    return issues.groupBy(*key).agg(F.count("*").alias("issues_found"), F.min_by("severity", severity_rank(F.col("severity"))).alias("severity_max"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def inline_eligible(issues: DataFrame, key: str, worst: str = "medium", cap: int = 15) -> DataFrame:
    """Issues that get a comment of their own: at least as bad as `worst`, with a line above 0, the worst first, at most `cap`."""
    rank = severity_rank(F.col("severity"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank, "idx"))
    return issues.where((rank <= SEVERITIES.index(worst)) & (F.col("line") > 0)).withColumn("place", place).where(F.col("place") <= cap).select(key, "place", "idx", "severity", "line")


def visible_issues(issues: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """Issues in the order of a report, with whether they are shown or folded away."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), "idx"))
    return issues.select(key, "idx", "severity").withColumn("place", place).withColumn("visible", F.col("place") <= shown)


def event_by_sections(issues: DataFrame, key: str, critical: int = 1, approve: int = 0) -> DataFrame:
    """(key, event): counts over the report's sections; an issue whose description speaks of security stands in two of them and counts twice.
    At least `critical` critical ones ask for changes, at most `approve` issues in all are approved."""
    twice = F.when(F.lower("description").contains("security"), 2).otherwise(1)
    got = issues.groupBy(key).agg(F.sum(F.when(F.col("severity") == "critical", twice).otherwise(0)).alias("c"), F.sum(twice).alias("all"))
    return got.select(key, F.when(F.col("c") >= critical, "REQUEST_CHANGES").when(F.col("all") <= approve, "APPROVE").otherwise("COMMENT").alias("event"))


def review_sections(issues: DataFrame, key: str) -> DataFrame:
    """(key, section, title, content, issues, collapsible): the sections of a report - the critical and high issues whose description speaks of security,
    and all critical, high and medium ones - with how many stand in each; sections without any are left out."""
    worst = issues.where(F.col("severity").isin("critical", "high", "medium"))
    secure = F.col("severity").isin("critical", "high") & F.coalesce(F.lower("description").contains("security"), F.lit(False))
    counts = worst.groupBy(key).agg(F.count_if(secure).alias("a"), F.count("*").alias("b"))
    # Titles, texts, and the numbers above which a section is folded.
    first = F.struct(F.lit(1).alias("section"), F.lit("Security Analysis").alias("title"), F.lit("Critical security vulnerabilities detected that require immediate attention.").alias("content"), F.col("a").alias("issues"), (F.col("a") > 5).alias("collapsible"))
    second = F.struct(F.lit(2).alias("section"), F.lit("Code Quality Issues").alias("title"), F.format_string("Found %d issues requiring attention.", "b").alias("content"), F.col("b").alias("issues"), (F.col("b") > 10).alias("collapsible"))
    return counts.select(key, F.inline(F.array(first, second))).where("issues > 0")


def overlay_merge(base: DataFrame, overlay: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of both by key within group, the overlay's first; rows with a null or empty key are dropped; source tells where a row is from.

    Of several rows of one source and key the first by idx stays, and of those equal in it the one whose other columns come first.
    """
    both = overlay.withColumn("source", F.lit("temporary")).withColumn("__o", F.lit(0)).unionByName(base.withColumn("source", F.lit("permanent")).withColumn("__o", F.lit(1)))
    others = [c for c in overlay.columns if c not in (group, key, "idx")]
    first = F.row_number().over(Window.partitionBy(group, key).orderBy("__o", "idx", *others))
    return both.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("__r", first).where("__r = 1").drop("__r", "__o")


def union_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def search_merge(base: DataFrame, overlay: DataFrame, group: str, min_overlay: float, limit: int = 10, text: str | None = None) -> DataFrame:
    """Hits of both, best first, the base's first among equals; overlay hits need min_overlay. With text, the column of that name, hits whose words are
    those of a better one that stays, or nearly so, leave before the limit is counted."""
    both = base.withColumn("source", F.lit("permanent")).unionByName(overlay.where(F.col("score") >= min_overlay).withColumn("source", F.lit("temporary")))
    if text is not None:
        both = _unlike(both, group, limit, text)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "source", "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit)


def _unlike(hits: DataFrame, group: str, limit: int, text: str) -> DataFrame:
    """Hits of each group that are near no better one that stays, best first: at least the first `limit` of them, where there are so many.

    What stays of a group's first texts doesn't depend on the later ones, so the first `WIDE * limit` different texts are asked, and eight times as many
    where too few of them stay. Of hits with one text only the best can stay, so a group's texts are counted with their best scores; then the hits that
    score less than the last of these texts leave before anything moves. Hits without words are near nothing and count each by itself.
    """
    source, words = F.col("source"), F.coalesce(F.col(text), F.lit(""))
    bare = ~words.rlike(r"(?U)\S")
    digest = {f"__d{i}": F.when(bare, F.xxhash64(F.lit(i), source, F.col("id"))).otherwise(F.xxhash64(F.lit(i), words)) for i in (1, 2)}
    value = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))  # as the order has it, nulls last
    keys = [F.col(group), F.col("__d1"), F.col("__d2")]
    out, asked, most = None, hits, WIDE * limit
    while True:
        best = asked.select(group, value.alias("__best"), *(c.alias(n) for n, c in digest.items())).groupBy(*keys).agg(F.max("__best").alias("__best"))
        rank = F.rank().over(Window.partitionBy(group).orderBy(F.desc("__best")))  # ties come along, so what is left scores less
        best = stage(best.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank"), "best").withColumnRenamed(group, "__group")
        groups = stage(best.groupBy("__group").agg(F.min("__best").alias("__least"), F.count("*").alias("__texts")), "groups")
        same = F.col(group).eqNullSafe(F.col("__group"))
        first = asked.join(_small(groups.drop("__texts")), same).where(value >= F.col("__least")).drop("__group", "__least").withColumns(digest)
        ends = [F.col(c).alias(f"{c}_") if c != "__group" else F.col(c) for c in best.columns]
        first = first.join(best.select(*ends), same & (F.col("__d1") == F.col("__d1_")) & (F.col("__d2") == F.col("__d2_")) & (value == F.col("__best_")))
        first = first.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy("source", "id"))).where("__first = 1").select(*hits.columns)
        place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "source", "id"))
        first = stage(first.withColumn("idx", place), "first")
        stays = greedy_dedupe(first, group, ["idx"], text).select(F.col(group).alias("__group"), F.col("idx").alias("__idx"))
        kept = stage(first.join(stays, same & (F.col("idx") == F.col("__idx")), "left_semi").drop("idx"), "stays")
        # Fewer texts than were asked for are all that a group has.
        enough = kept.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__stay")).where(F.col("__stay") >= limit)
        more = stage(groups.where(F.col("__texts") >= most).join(enough, F.col("__group").eqNullSafe(F.col("__g")), "left_anti").select("__group"), "more")
        done = more.isEmpty()
        kept = kept if done else kept.join(more, same, "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if done:
            return out
        asked, most = hits.join(_small(more), same, "left_semi"), 8 * most


def _small(groups: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A staged table to be broadcast if it has no more rows than that."""
    return F.broadcast(groups) if groups.count() <= rows else groups


def consistency(vectors: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """(key, vectors, nodes, state): whether both stores hold a repository, or which one alone does."""
    v = vectors.groupBy(key).agg(F.count("*").alias("vectors"))
    g = graph.groupBy(key).agg(F.count("*").alias("nodes"))
    both = v.join(g, key, "full_outer")
    state = F.when(F.col("vectors").isNull(), "orphan_graph").when(F.col("nodes").isNull(), "orphan_vectors").otherwise("consistent")
    return both.select(key, F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("nodes", F.lit(0)).alias("nodes"), state.alias("state"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified or deleted between two snapshots."""
    both = old.select(key, F.col(digest).alias("__a")).join(new.select(key, F.col(digest).alias("__b")), key, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def review_history(reviews: DataFrame, key: str, limit: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("review_id")))
    return reviews.withColumn("place", rank).where(F.col("place") <= limit)


def review_compare(reviews: DataFrame, key: str, measures: tuple[str, ...] = ("score", "files", "issues", "critical", "high", "medium", "low")) -> DataFrame:
    """Differences of each key's last two reviews, missing values as 0."""
    last = review_history(reviews, key, 2)
    a, b = last.where("place = 1").alias("a"), last.where("place = 2").alias("b")
    delta = [(F.coalesce(f"a.{m}", F.lit(0)) - F.coalesce(f"b.{m}", F.lit(0))).alias(f"{m}_change") for m in measures]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), F.col("a.review_id").alias("new_review"), F.col("b.review_id").alias("old_review"), *delta)


# How a review text names a line; file and line groups, 0 for none.
LINE_REFS = ((r"L(\d+)[+-]", 0, 1), (r"([a-zA-Z0-9_/.]+\.\w+):(\d+)", 1, 2), (r"([a-zA-Z0-9_/.]+\.\w+)\s+[Ll]ine\s+(\d+)", 1, 2), (r"\[([a-zA-Z0-9_/.]+\.\w+)#L(\d+)\]", 1, 2), (r"[Ll]ine\s+(\d+):?", 0, 1))


def _reference(pattern: Column):
    return lambda x: F.struct(pattern.alias("pattern"), x["file"].alias("file"), x["line"].try_cast("int").alias("line"))


def line_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern, file, line): every reference of every form, also where two forms see the same one."""
    parts = []
    for i, (pattern, file_group, line_group) in enumerate(LINE_REFS):
        lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(line_group))
        files = F.regexp_extract_all(text, F.lit(pattern), F.lit(file_group)) if file_group else F.transform(lines, lambda _: F.lit("unknown"))
        parts.append(F.transform(F.arrays_zip(files.alias("file"), lines.alias("line")), _reference(F.lit(i))))
    out = texts.select(key, F.explode(F.flatten(F.array(*parts))).alias("ref")).select(key, "ref.pattern", "ref.file", "ref.line")
    return out.where("line is not null")


def review_validity(texts: DataFrame, checked: DataFrame, key: str, text: str, share: float = 0.8, long: int = 500) -> DataFrame:
    """(key, refs, valid_refs, valid): a text is invalid if too few of its references are in the diff, or if it is long and has none."""
    got = checked.groupBy(key).agg(F.count("*").alias("refs"), F.count_if("in_diff").alias("valid_refs"))
    both = texts.select(key, F.char_length(text).alias("__n")).join(got, key, "left")
    refs, good = F.coalesce("refs", F.lit(0)), F.coalesce("valid_refs", F.lit(0))
    bad = ((refs > 0) & (good < share * refs)) | ((refs == 0) & (F.col("__n") > long))
    return both.select(key, refs.alias("refs"), good.alias("valid_refs"), (~bad).alias("valid"))


# Phrases that say nothing by themselves, figures that a review can't know, quotes in a fence and in a line.
PHRASES = ("consider implementing", "it would be better", "you should", "recommend adding", "could be improved")
FIGURES = (r"cyclomatic complexity of \p{Nd}+", r"complexity score of \p{Nd}+", r"\p{Nd}+/\p{Nd}+ score")
QUOTES = (r"(?s)```(?U:\w*)\n.*?\n```", r"`[^`]{15,}`")


#: What a review says when it uses the kinds of context it was given; the signs count in any text, the words in lower case.
CONTEXT_WORDS = {
    "dependencies": (("dependenc", "depends on"), "→"),
    "similar_code": (("similar", "pattern", "duplicate"), "🔍"),
    "entities": (("entit", "function", "class"), None),
}
UNUSED_CONTEXT = {
    "dependencies": "GraphRAG has {} dependencies but review doesn't mention them",
    "similar_code": "GraphRAG has {} similar code patterns but review doesn't mention them",
}


def context_usage(reviews: DataFrame, contexts: DataFrame, on: list[str], text: str) -> DataFrame:
    """reviews with has_context, mentions_dependencies, mentions_similar_code, mentions_entities, utilisation (percent of the kinds of context there
    were that the text speaks of) and issues, an array of texts.

    contexts(on..., dependencies, similar_code, entities): counts of each file's context, which are summed. A review without contexts, or with a null
    key, mentions nothing and has 0; null texts are empty, null counts 0.
    """
    kinds = list(CONTEXT_WORDS)
    sums = contexts.groupBy(*on).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(f"__{k}") for k in kinds), F.lit(True).alias("__any"))
    met = reviews.join(sums, on, "left").withColumn("__has", F.coalesce("__any", F.lit(False)))
    body = F.coalesce(F.col(text), F.lit(""))

    def said(kind: str) -> Column:
        words, sign = CONTEXT_WORDS[kind]
        found = [F.contains(F.lower(body), F.lit(w)) for w in words] + ([F.contains(body, F.lit(sign))] if sign else [])
        hit = found[0]
        for more in found[1:]:
            hit = hit | more
        return hit & F.col("__has")

    there = {k: F.coalesce(F.col(f"__{k}"), F.lit(0)) for k in kinds}
    met = met.withColumns({f"mentions_{k}": said(k) for k in kinds})
    available = sum(((there[k] > 0).cast("int") for k in kinds), F.lit(0))
    used = sum((((there[k] > 0) & F.col(f"mentions_{k}")).cast("int") for k in kinds), F.lit(0))
    issues = [F.when((there[k] > 0) & ~F.col(f"mentions_{k}"), F.replace(F.lit(t), F.lit("{}"), there[k].cast("string"))) for k, t in UNUSED_CONTEXT.items()]
    share = F.coalesce(F.try_divide(used.cast("double"), available) * 100, F.lit(0.0))
    out = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return met.select(*reviews.columns, F.col("__has").alias("has_context"), *(f"mentions_{k}" for k in kinds), share.alias("utilisation"), out.alias("issues"))


def existing_review(reviews: DataFrame, signature: str, key: str, order: str, text: str) -> DataFrame:
    """(key, order): of each key the first review, by order, whose text contains the signature; keys without one are left out."""
    return reviews.where(F.contains(text, F.lit(signature))).groupBy(key).agg(F.min(order).alias(order))


def text_checks():
    """A function of a text column to a struct: quotes (fenced ones, and inline ones of 15 characters), generic statements without a line within a hundred
    characters, and fabricated metrics, of which each counts as often as its form occurs."""

    def check(text) -> Column:
        text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        count = lambda p: F.regexp_count(text, F.lit(p))
        quotes = sum((count(p) for p in QUOTES), F.lit(0))
        # "line 1" has six characters, so it lies within a hundred if at most 94 are between. The phrase comes first, so what is around is looked at only there.
        generic = sum((count(rf"(?isu){p}(?<!line \p{{Nd}}.{{0,94}}{p})(?!.{{0,94}}line \p{{Nd}})") for p in PHRASES), F.lit(0))
        metrics = sum((count(f"(?iu){p}") * count(f"(?iu){p}") for p in FIGURES), F.lit(0))
        return F.struct(quotes.alias("quotes"), generic.alias("generic"), metrics.alias("metrics"))

    return check


def quotes_in_patches():
    """A pandas UDF of (text, patch): how many of a text's quotes stand in the patch, and how many don't."""
    @F.pandas_udf("found int, missing int")
    def check(texts: pd.Series, patches: pd.Series) -> pd.DataFrame:
        import re

        rows = []
        for t, p in zip(texts.fillna(""), patches.fillna(""), strict=True):
            quotes = re.findall(r"```[\w]*\n(.*?)\n```", t, re.DOTALL) + re.findall(r"`([^`]{15,})`", t)
            found = sum(quote_in_patch(q, p) for q in quotes)
            rows.append((found, len(quotes) - found))
        return pd.DataFrame(rows, columns=["found", "missing"])

    return check


def quote_in_patch(quote: str, patch: str) -> bool:
    """Whether a quote stands in a patch, white space aside; short ones pass, of long ones half of their words in a row suffice."""
    q, p = " ".join(quote.split()), " ".join(patch.split())
    if len(q) < 20 or q in p:
        return True
    words = q.split()
    size = max(4, len(words) // 2)
    return len(q) > 50 and len(words) > 5 and any(" ".join(words[i : i + size]) in p for i in range(len(words) - size))
