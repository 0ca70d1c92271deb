"""The engine's façade: one method for each question the service answers, over tables in a folder or given as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decide
from .operators import diff, graph, review, rules, vector
from .sources import ingest, layout
from .sources.store import BUCKETS, Change, Store, stage

#: The tables of a repository: columns without repo_id, and the column that rows are bucketed by.
TABLES = {
    "entities": ("file string, name string, type string, start_line int, end_line int, raw_code string, uid string", "file"),
    "mentions": ("src_uid string, src_file string, name string", "src_file"),
    "calls": ("src_uid string, dst_uid string", "src_uid"),
    "chunks": ("id string, file string, name string, type string, start_line int, raw_code string, embedding array<float>", "id"),
}


class Engine:
    """Tables of repositories: entities, what their code mentions, calls and chunks, all keyed by repo_id.

    Each change of a repository is one commit over all of its tables: readers see all of it or nothing, and what fails leaves the former state
    (see sources/store.py). progress is called with (repo_id, stage, rows, seconds) as the stages of a change end.
    """

    def __init__(self, spark: SparkSession, root: str, encoder=None, buckets: int = BUCKETS, progress: Callable[[str, str, int, float], None] | None = None):
        self.spark, self.store = spark, Store(spark, root, TABLES, buckets)
        self._encode = encoder or vector.hashing_encoder()
        self._progress = progress or (lambda *_: None)

    @property
    def entities(self) -> DataFrame:
        return self.store.read("entities")

    @property
    def calls(self) -> DataFrame:
        return self.store.read("calls")

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def ingest(self, path: str, repo_id: str) -> dict[str, int]:
        """Scans, captures, projects, embeds and links a repository's files, which replace its former rows; rows written by table.

        Files are parsed once, and rows counted as they are written.
        """
        with self.store.change(repo_id) as change:
            found = stage(ingest.captures(ingest.scan_files(self.spark, path, repo_id)), "captures")
            steps = {
                "entities": lambda: graph.last_captured(ingest.entities(found)),
                "mentions": lambda: graph.mentions(change.read("entities"), graph.callable_names(change.read("entities"))),
                "calls": lambda: graph.resolve(change.read("mentions"), change.read("entities")),
                "chunks": lambda: self._embedded(found),
            }
            for table, rows in steps.items():
                self._step(change, table, lambda table=table, rows=rows: change.replace(table, rows()))
        return {t: m["rows"] for t, m in change.metrics.items()}

    def update(self, files: DataFrame, repo_id: str, deleted: DataFrame | None = None) -> dict[str, int]:
        """Takes changed files(file, language, content) of a repository in, and the files of deleted(file) out; rows written by table.

        Only buckets of the files, and of their chunks, are written anew, and only what the files change is linked (graph.relink). Files that
        can't be parsed lose their rows. The same files once more change nothing but the version.
        """
        files = files.select(F.lit(repo_id).alias("repo_id"), "file", "language", "content")
        with self.store.change(repo_id) as change:
            changed = files.select("file") if deleted is None else files.select("file").unionByName(deleted.select("file"))
            changed = stage(changed.where("file is not null").distinct().select(F.lit(repo_id).alias("repo_id"), "file"), "changed")
            found = stage(ingest.captures(files), "captures")
            self._step(change, "entities", lambda: change.upsert("entities", graph.last_captured(ingest.entities(found)), changed))
            mentioned, calls = graph.relink(change.was("entities"), change.read("entities"), change.was("mentions"), change.was("calls"), changed)
            self._step(change, "mentions", lambda: change.replace("mentions", mentioned))
            self._step(change, "calls", lambda: change.replace("calls", calls))
            former = change.was("chunks").join(changed, ["repo_id", "file"], "left_semi").select("id")
            self._step(change, "chunks", lambda: change.upsert("chunks", stage(self._embedded(found), "chunks"), former))
        return {t: m["rows"] for t, m in change.metrics.items()}

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Takes a micro-batch of files(repo_id, file, language, content, deleted boolean) in, one commit for each repository; of a file that stands
        in it more than once, a row that isn't deleted counts, the one with the largest content. A batch that comes twice changes nothing."""
        last = F.max_by(F.struct("language", "content", "deleted"), F.struct(~F.col("deleted"), "content"))
        batch = stage(batch.groupBy("repo_id", "file").agg(last.alias("last")).select("repo_id", "file", "last.*"), "batch")
        for row in batch.select("repo_id").distinct().toLocalIterator():  # no more than the batch has files
            mine = batch.where(F.col("repo_id") == row["repo_id"])
            self.update(mine.where("not deleted"), row["repo_id"], mine.where("deleted"))

    def upsert_chunks(self, repo_id: str, chunks: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """chunks replace those of the same id and the ids of gone(id) leave; only their buckets are written. How many rows and buckets that were."""
        with self.store.change(repo_id) as change:
            change.upsert("chunks", chunks, gone)
        return change.metrics.get("chunks", {"rows": 0, "buckets": 0})

    def _embedded(self, found: DataFrame) -> DataFrame:
        return ingest.chunks(found).dropDuplicates(["id"]).withColumn("embedding", self._encode("raw_code"))

    def _step(self, change: Change, table: str, run: Callable[[], object]) -> None:
        began = time.time()
        run()
        self._progress(change.repo_id, table, change.metrics.get(table, {"rows": 0})["rows"], time.time() - began)

    def delete(self, repo_id: str) -> None:
        """Takes a repository out of all tables."""
        self.store.drop(repo_id)

    def lay_out(self, repo_id: str | None = None, buckets: int | None = None) -> layout.Layout:
        """The graph of a repository, or of all, as it is now, in buckets by uid: for many questions about one version."""
        return layout.lay_out(self.store.read("entities", repo_id), self.store.read("calls", repo_id), buckets)

    def query(self, repo_id: str, text: str, k: int = 5) -> DataFrame:
        """The k chunks nearest to a text, each with up to five of what the entities at its place call."""
        hits = self.search(repo_id, text, k)
        near = self.store.read("entities", repo_id).join(hits.select("id", F.col("file"), F.col("start_line").alias("line")), "file").where(F.abs(F.col("start_line") - F.col("line")) <= 1)
        called = near.join(self.store.read("calls", repo_id).drop("repo_id"), F.col("uid") == F.col("src_uid")).groupBy("id").agg(F.slice(F.array_sort(F.collect_set("dst_uid")), 1, 5).alias("related_dependencies"))
        return hits.join(called, "id", "left").orderBy("rank")

    def search(self, repo_id: str, text: str, k: int = 5, min_score: float | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, repo_id, text)], "query_id int, repo_id string, text string").withColumn("query", self._encode("text")).drop("text")
        return vector.search(self.store.read("chunks", repo_id), asked, k, min_score)

    def similar(self, repo_id: str, text: str, k: int = 5, min_score: float = 0.7) -> DataFrame:
        return self.search(repo_id, text, k, min_score)

    def duplicates(self, repo_id: str, text: str, k: int = 3) -> DataFrame:
        return self.search(repo_id, text, k, 0.9)

    def stats(self, repo_id: str) -> DataFrame:
        return vector.repo_stats(self.store.read("chunks", repo_id))

    def analyze_files(self, files: DataFrame) -> DataFrame:
        """Issues of files(filename, language, text)."""
        lines = rules.lines_of(files, "text", "filename", "language")
        return rules.line_issues(lines)

    def analyze_diff(self, patches: DataFrame) -> DataFrame:
        """Issues of the added lines of patches(pr, filename, language, patch), numbered among a file's added lines."""
        added = diff.patch_lines(patches, "pr", "filename", "language").where("type = 'add'")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
        joined = added.groupBy("pr", "filename", "language").agg(text.alias("text"))
        return rules.line_issues(rules.lines_of(joined, "text", "pr", "filename", "language"))

    def review_plan(self, prs: DataFrame, deep: Column | None = None) -> DataFrame:
        """Risk, strategy and model of pull requests(pr, files, additions, security_critical, critical, high, callers)."""
        risk = decide.risk_level(*(F.col(c) for c in ("security_critical", "critical", "high", "callers", "additions")))
        planned = prs.withColumn("risk", risk).withColumn("strategy", decide.review_strategy(F.col("files"), F.col("additions"), F.col("risk"), F.lit(False) if deep is None else deep))
        return planned.withColumn("model", decide.model_choice(F.col("strategy"), F.col("files"), F.col("additions"), F.col("risk")))

    def validate_review(self, reviews: DataFrame, patches: DataFrame) -> DataFrame:
        """Whether the lines that reviews(pr, text) speak of are in the patches(pr, filename, patch)."""
        refs = review.line_references(reviews, "pr", "text")
        return review.review_validity(reviews, diff.lines_in_diff(refs, patches, "pr"), "pr", "text")
