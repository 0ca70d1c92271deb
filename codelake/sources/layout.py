"""A repository's graph as bucketed and sorted tables, so that questions about calls don't move them.

Entities lie by uid. Calls carry what is asked of both of their ends and are kept twice, by the uid that calls and by the uid that is called, so
either end is a key: joins on it find both sides in the same bucket, counts by it need no exchange, and a lookup reads one bucket. The tables are
written once for a version of the graph, which shuffles the calls twice; that pays off from the second question on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import Links
from .store import shared_folder

#: Rows that a bucket should hold; the number of buckets follows from them.
ROWS = 2_000_000
MOST = 8_192


@dataclass(frozen=True)
class Layout:
    """Names of the catalogue's tables: entities by uid, calls by src_uid and calls by dst_uid."""

    spark: SparkSession
    names: tuple[str, str, str]
    paths: tuple[str, str, str]

    @property
    def entities(self) -> DataFrame:
        return self.spark.table(self.names[0])

    @property
    def outgoing(self) -> DataFrame:
        return self.spark.table(self.names[1])

    @property
    def incoming(self) -> DataFrame:
        return self.spark.table(self.names[2])

    def drop(self) -> None:
        """Takes the tables out of the catalogue and deletes their files."""
        for name, path in zip(self.names, self.paths, strict=True):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _save(df: DataFrame, name: str, path: str, key: str, buckets: int, measured: list[str]) -> None:
    # Dealt by the bucket's own hash, so that each bucket is one file.
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(measured)}")


def lay_out(entities: DataFrame, calls: DataFrame, buckets: int | None = None, name: str = "graph") -> Layout:
    """Writes entities and calls(repo_id, src_uid, dst_uid) as a Layout in the shared folder, with statistics of the columns that queries filter by.

    buckets: by the number of calls or entities, whichever is larger, if not told. Calls without both ends among the entities are left out. uids
    are unique over all repositories. A null uid is nobody's end; empty tables give empty ones.
    """
    spark, mark = entities.sparkSession, uuid.uuid4().hex
    if buckets is None:
        buckets = min(MOST, max(1, -(-max(entities.count(), calls.count()) // ROWS)))
    names = tuple(f"{name}_{part}_{mark}" for part in ("entities", "outgoing", "incoming"))
    layout = Layout(spark, names, tuple(f"{shared_folder(spark)}/codelake/{n}" for n in names))
    _save(entities, names[0], layout.paths[0], "uid", buckets, ["repo_id", "uid", "type", "start_line"])

    def end(side: str) -> DataFrame:
        return layout.entities.select(F.col("uid").alias(f"{side}_uid"), *(F.col(c).alias(f"{side}_{c}") for c in ("name", "file", "type", "start_line")))

    known = calls.select("repo_id", "src_uid", "dst_uid").join(end("src"), "src_uid").join(end("dst"), "dst_uid")
    _save(known, names[1], layout.paths[1], "src_uid", buckets, ["repo_id", "src_uid", "dst_uid"])
    _save(layout.outgoing, names[2], layout.paths[2], "dst_uid", buckets, ["repo_id", "src_uid", "dst_uid"])
    return layout


def lay_out_links(links: Links, buckets: int | None = None, name: str = "mentions") -> Links:
    """Links in buckets: entities by uid, what functions say by src_uid, and mentions, a row each, by the name that is said.

    A call is a mention of a name that its target bears, so the two sides of a call lie by the function and by the name: counts and first rows by
    either find their rows in a bucket, and a mention moves once, where lay_out moves every call twice with both of its ends.
    """
    spark, mark = links.entities.sparkSession, uuid.uuid4().hex
    if buckets is None:
        buckets = min(MOST, max(1, -(-links.mentioned.count() // ROWS)))
    parts = (("entities", links.entities, "uid", ["repo_id", "uid", "type"]), ("said", links.found, "src_uid", ["repo_id", "src_uid"]), ("names", links.mentioned, "name", ["repo_id", "name"]))
    for part, rows, key, measured in parts:
        _save(rows, f"{name}_{part}_{mark}", f"{shared_folder(spark)}/codelake/{name}_{part}_{mark}", key, buckets, measured)
    return Links(*(spark.table(f"{name}_{part}_{mark}") for part, *_ in parts))


def node(layout: Layout, uid: str) -> DataFrame:
    """The entity of a uid; one bucket is read."""
    return layout.entities.where(F.col("uid") == uid)


def node_dependencies(layout: Layout, uid: str) -> DataFrame:
    """(direction, uid, name, type, file, start_line): what an entity calls and what calls it; one bucket of either table is read."""
    out = layout.outgoing.where(F.col("src_uid") == uid).select(F.lit("calls").alias("direction"), *(F.col(f"dst_{c}").alias(c) for c in ("uid", "name", "type", "file", "start_line")))
    into = layout.incoming.where(F.col("dst_uid") == uid).select(F.lit("called_by").alias("direction"), *(F.col(f"src_{c}").alias(c) for c in ("uid", "name", "type", "file", "start_line")))
    return out.unionByName(into)


def degrees(layout: Layout | Links) -> DataFrame:
    """(repo_id, uid, callees, callers) of every entity, zeros included: counts and joins within buckets, without any exchange; of links, only what
    files say of a name is met with the entities."""
    if isinstance(layout, Links):
        out, into = layout.fanout().select(F.col("src_uid").alias("uid"), F.col("calls").alias("callees")), layout.fanin().select(F.col("dst_uid").alias("uid"), F.col("calls").alias("callers"))
        return layout.entities.select("repo_id", "uid").join(out, "uid", "left").join(into, "uid", "left").na.fill(0, ["callees", "callers"])
    out = layout.outgoing.groupBy(F.col("src_uid").alias("uid")).agg(F.count("*").alias("callees"))
    into = layout.incoming.groupBy(F.col("dst_uid").alias("uid")).agg(F.count("*").alias("callers"))
    both = layout.entities.select("repo_id", "uid").join(out, "uid", "left").join(into, "uid", "left")
    return both.select("repo_id", "uid", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"))
