"""Where reviews are kept: their rows, their comments and the files that they speak of, in one commit a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decide import severity_rank
from ..operators.dedupe import places
from .store import BUCKETS, Store, stage

#: Comments of a file, in their order, that one row holds while they meet functions; and functions of one range of lines.
BLOCK, TOGETHER = 2048, 256

REVIEW = (
    "review_id string, pull_request_id string, status string, summary struct<overallScore:int,filesChanged:int,issuesFound:int,critical:int,high:int,medium:int,low:int,info:int>, "
    "key_changes array<string>, recommendations array<string>, positives array<string>, primary_model string, total_tokens_input bigint, total_tokens_output bigint, "
    "total_cost double, execution_time_ms bigint, started_at timestamp, completed_at timestamp"
)
COMMENT = "review_id string, file_path string, line_start int, line_end int, severity string, category string, title string, description string, suggestion string, code_snippet string"
TABLES = {
    "reviews": (REVIEW, "review_id"),
    "review_comments": (COMMENT, "review_id"),
    "reviewed_file": ("review_id string, file_path string, issues_found bigint, severity_max string, categories array<string>", "review_id"),
}


class ReviewStore:
    """Reviews of repositories; saving a review again replaces it and all of its comments."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.store = Store(spark, root, TABLES, buckets)

    def save(self, repo_id: str, reviews: DataFrame, comments: DataFrame) -> dict[str, int]:
        """Writes reviews with their comments, and what each says of each file; rows written by table. Comments of other reviews, and rows without an id, are
        left out. Of rows with one review_id the one that was completed last stays."""
        last = F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc_nulls_last("completed_at"), F.desc_nulls_last("started_at"), F.xxhash64(*reviews.columns)))
        reviews = stage(reviews.where("review_id is not null").withColumn("__last", last).where("__last = 1").drop("__last"), "reviews")
        ids = reviews.select("review_id")
        comments = stage(comments.join(ids, "review_id", "left_semi"), "comments")
        rank = severity_rank(F.col("severity"))
        edges = comments.groupBy("review_id", "file_path").agg(F.count("*").alias("issues_found"), F.min_by("severity", rank).alias("severity_max"), F.array_sort(F.collect_set("category")).alias("categories"))
        with self.store.change(repo_id) as change:
            change.upsert("reviews", reviews)
            change.upsert("review_comments", comments, ids)
            change.upsert("reviewed_file", edges, ids)
        return {t: m["rows"] for t, m in change.metrics.items()}

    def sink(self, batch: DataFrame, batch_id: int = 0) -> None:
        """For foreachBatch: rows of REVIEW with repo_id and comments, an array of comments. A batch that comes again leaves the rows as they are."""
        batch = stage(batch, "batch")
        for row in batch.where("repo_id is not null").select("repo_id").distinct().toLocalIterator():  # one commit for each repository of the batch
            mine = batch.where(F.col("repo_id") == row["repo_id"])
            said = mine.select(F.col("review_id").alias("__review"), F.inline("comments")).withColumn("review_id", F.col("__review")).drop("__review")
            self.save(row["repo_id"], mine.drop("repo_id", "comments"), said)

    def history(self, repo_id: str, limit: int = 10) -> DataFrame:
        """The last reviews of each pull request of a repository, with their place from 1."""
        return newest(self.store.read("reviews", repo_id), ["pull_request_id"], limit)

    def file_history(self, repo_id: str, limit: int = 10) -> DataFrame:
        """The last reviews of each file, with what they said of it."""
        return file_history(self.store.read("reviews", repo_id), self.store.read("reviewed_file", repo_id), limit)

    def function_issues(self, repo_id: str, entities: DataFrame) -> DataFrame:
        """Every comment on a line of a function of entities, the newest review's first."""
        return function_issues(self.store.read("reviews", repo_id), self.store.read("review_comments", repo_id), entities.where(F.col("repo_id") == repo_id))


def newest(reviews: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The `limit` reviews of each key that were completed last, with place."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("completed_at"), F.desc("review_id")))
    return reviews.withColumn("place", place).where(F.col("place") <= limit)


def file_history(reviews: DataFrame, reviewed: DataFrame, limit: int = 10) -> DataFrame:
    """(file_path, place, review_id, completed_at, issues_found, severity_max, categories): the last reviews of each file."""
    met = reviewed.join(reviews.select("review_id", "completed_at"), "review_id")
    return newest(met, ["file_path"], limit).select("file_path", "place", "review_id", "completed_at", "issues_found", "severity_max", "categories")


def function_issues(reviews: DataFrame, comments: DataFrame, entities: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file_path, function, review_id, line, severity, category, title, place): comments whose line lies in a function; place orders a function's, the
    newest review's first. Lines of comments count from 1, those of entities from 0; a line in several functions stands with each.

    The rows grow with comments times functions of a file, so they are made last and never move: a file's comments are cut into blocks in their order, and
    a place is how many comments the range of lines has in the blocks before, and the place among those of its own. Functions of one range share the work.
    """
    range_ = ["file_path", "start_line", "end_line"]
    functions = entities.where("type = 'Function' and start_line <= end_line").select(F.col("file").alias("file_path"), F.col("name").alias("function"), "start_line", "end_line")
    dated = comments.join(reviews.select("review_id", "completed_at"), "review_id").join(functions.select("file_path").distinct(), "file_path", "left_semi")
    order = [F.desc_nulls_last("completed_at"), F.desc("review_id"), "line_start", "title", "description", "severity", "category"]
    told = places(dated.where("line_start is not null"), "file_path", *order).withColumn("block", F.floor((F.col("place") - 1) / block))
    items = F.sort_array(F.collect_list(F.struct("place", "line_start", "review_id", "severity", "category", "title")))
    blocks = stage(told.groupBy("file_path", "block").agg(items.alias("items")), "issue_blocks")

    lines = blocks.select("file_path", "block", F.explode("items.line_start").alias("line")).groupBy("file_path", "block", "line").agg(F.count("*").alias("n"))
    met = lines.join(functions.select(*range_).distinct(), "file_path").where("line - 1 between start_line and end_line").groupBy(*range_, "block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*range_).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    met = met.select(*range_, "block", F.coalesce(before, F.lit(0)).alias("before"))
    # Names of a range come in lists of bounded length.
    part = F.floor((F.row_number().over(Window.partitionBy(*range_).orderBy("function")) - 1) / TOGETHER)
    named = functions.withColumn("__part", part).groupBy(*range_, "__part").agg(F.collect_list("function").alias("functions")).drop("__part")
    met = blocks.join(met.join(named, range_).hint("merge"), ["file_path", "block"])
    own = F.filter("items", lambda i: (i["line_start"] - 1 >= F.col("start_line")) & (i["line_start"] - 1 <= F.col("end_line")))
    met = met.select("file_path", "functions", "before", F.posexplode(own).alias("at", "item")).select("file_path", F.explode("functions").alias("function"), "item", "before", "at")
    item = [F.col(f"item.{c}") for c in ("review_id", "line_start", "severity", "category", "title")]
    return met.select("file_path", "function", item[0], item[1].alias("line"), *item[2:], (F.col("before") + F.col("at") + 1).cast("int").alias("place"))
