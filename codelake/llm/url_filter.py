"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts, in DataFrame operations only.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are distrusted ones. Trust runs along the links
(personalised PageRank from the trusted seeds), distrust against them (from the blocked seeds over reversed links). A host whose share of
distrust is above a threshold is blocked where no rule speaks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stage_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Share of the rank that is passed on in each step, steps between checkpoints, and the share of distrust from which on a host is blocked.
DAMPING, CUT_EVERY, THRESHOLD = 0.85, 4, 0.5

#: Ranks are final when no host's changes by a larger part of it in a step, a first rank being all change.
TOLERANCE = 1e-9

#: Steps of the SQL, which can't iterate until nothing changes; its rows are the same where no host links to another.
STEPS = 12

LINKS = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def after_scheme(url: Column) -> Column:
    """What follows the first ://, or empty."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, rules array<struct<size, name, path, verdict>>) for hosts that a rule's host covers, longest rules first."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.host + r.path, r.verdict) for r in rules], "rule_host string, path string, name string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(table, "rule_host")
    found = F.struct((-F.length("name")).alias("size"), "name", "path", "verdict")
    return wide.groupBy("host").agg(F.array_sort(F.collect_set(found)).alias("rules"))


def link_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, share): links from hosts to other hosts, each with its share of the source's links. pages needs host and the html column."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(LINKS), F.lit(1))
    # Links without a host stay on their page's own host and lead nowhere in this graph.
    absolute = F.transform(F.filter(links, lambda u: u.startswith("//") | u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")), lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))
    edges = pages.select(F.col("host").alias("src"), F.explode(absolute).alias("url")).select("src", host_of(F.col("url")).alias("dst"))
    counted = edges.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """(host, trust, distrust) from seeds(host, allowed, blocked), for hosts that any rank reaches: after `steps` steps, or until all are final.

    edges: (src, dst, share) as link_edges gives them. Reversed links share a host's distrust equally by their number of links' shares.
    Without `steps` there are as many as the longest way from a seed has links, at least, and some 130 where links run in circles.
    """
    back = edges.groupBy("dst").agg(F.sum("share").alias("all"))
    reversed_ = edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(1).alias("kind"), (F.col("share") / F.col("all")).alias("share"))
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(0).alias("kind"), "share").unionByName(reversed_)
    both = stage_table(both, "host-edges")
    start = seeds.select("host", F.lit(0).alias("kind"), F.col("allowed").cast("double").alias("rank")).unionByName(seeds.select("host", F.lit(1).alias("kind"), F.col("blocked").cast("double").alias("rank")))
    start = stage_table(start.where("rank > 0").withColumn("rank", F.col("rank") * (1 - damping)), "host-seeds")
    # was: the rank of the step before.
    ranks = start.withColumn("was", F.lit(0.0))
    seeded = start.withColumn("was", F.col("rank"))
    if not both.isEmpty():
        step = 0
        while steps is None or step < steps:
            step += 1
            sent = F.col("share") * damping
            moved = ranks.join(both, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("rank") * sent).alias("rank"), (F.col("was") * sent).alias("was"))
            ranks = seeded.unionByName(moved).groupBy("host", "kind").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
            if step % CUT_EVERY == 0:
                ranks = stage_table(ranks, "host-ranks")
                if steps is None and ranks.where(F.col("rank") - F.col("was") > TOLERANCE * F.col("rank")).isEmpty():
                    break
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def url_filter(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust): one row for each row of pages.

    rule names the longest rule (host and path joined; of equal ones the first by name) that fits, else null, and gives the verdict; otherwise
    the host is blocked if distrust / (trust + distrust) is above the threshold, and allowed if not or if nothing reaches it. A null url, or
    one without ://, has an empty host and path, which no rule fits. Null html has no links. What is told of a host with more than 1 / HOT of
    the pages meets them in a broadcast of fewer than HOT rows, the rest in a join on the host. Ranks are summed as they come, so the share of distrust is rounded to nine digits before
    it is compared, however small both ranks are; trust and distrust are rounded to nine places when they are given out, and only then.
    """
    url = F.col(url_col).cast("string")
    narrow = pages.select(F.col(id_col).alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    # What is told of a host meets its pages where they lie if it has many.
    hosts = stage_table(narrow.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    named = lambda found: found.join(hosts, "host").withColumnRenamed("host", "group")
    covered = named(host_rules(hosts.select("host"), rules))
    fit = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = join_groups(narrow, covered, F.col("host"), total, ["rules"]).select("id", "host", "path", F.try_element_at(fit, F.lit(1)).alias("fit"))
    ruled = ruled.select("id", "host", "path", F.col("fit.name").alias("rule"), F.col("fit.verdict").alias("ruling"))
    seeds = ruled.where("ruling is not null").groupBy("host").agg(F.count_if(F.col("ruling") == "allow").alias("allowed"), F.count_if(F.col("ruling") == "block").alias("blocked"))
    edges = link_edges(pages.select(F.coalesce(host_of(url), F.lit("")).alias("host"), F.col(html_col).alias("html")), "html")
    ranks = propagate(edges, seeds)
    bad = F.coalesce(F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 9) > threshold, F.lit(False))
    return join_groups(ruled, named(ranks), F.col("host"), total, ["trust", "distrust"]).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(F.col("ruling"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
