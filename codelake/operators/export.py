"""The whole graph as texts, a row a file: what a file's functions call is told from Links and written where the row is made, so neither a table of
calls nor a list of them is ever held, and a task holds the text of one file at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage
from . import graph
from .links import Links

#: Bytes of text that a task should write; a file is one task's work in any case. Parquet's writer keeps up to 100 rows before it looks at their size.
SHARE = 1 << 20
MOST = 20_000
KEY = ["repo_id", "file"]
META, TARGETS, HEAD, SAID = range(4)


def files_of(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo_id, file, imports, dependencies, total_nodes, total_files): every file of entities with what it imports, sorted, and its repository's totals."""
    held = entities.groupBy(*KEY).agg(F.count("*").alias("n"))
    totals = held.groupBy("repo_id").agg(F.sum("n").alias("total_nodes"), F.count("file").alias("total_files"))
    own = imports.groupBy(*KEY).agg(F.array_sort(F.collect_set("import")).alias("imports"))
    deps = graph.import_dependencies(imports, entities).groupBy(*KEY).agg(F.array_sort(F.collect_set("depends_on")).alias("dependencies"))
    none = F.array().cast("array<string>")
    out = held.join(own, KEY, "left").join(deps, KEY, "left").join(totals, "repo_id")
    return out.select(*KEY, F.coalesce("imports", none).alias("imports"), F.coalesce("dependencies", none).alias("dependencies"), "total_nodes", "total_files")


def graph_texts(entities: DataFrame, links: Links, imports: DataFrame, head: Column) -> DataFrame:
    """(repo_id, file, nodes, imports, dependencies, total_nodes, total_files): as context.graph_export, with texts in place of arrays.

    A node is its head, a bar, and the uids that it calls with commas between; nodes stand by uid with semicolons between. Names travel, each with
    its function once, and stand for uids only where a file's text is made; files are numbered and dealt out one by one, so that no task gets
    several large ones by chance.
    """
    files = stage(files_of(links.entities, imports), "files")
    many = files.count()
    calls = F.aggregate("said", F.lit(0).cast("long"), lambda a, x: a + x["others"])
    size = (links.found.agg(F.sum(calls)).first()[0] or 0) * (links.entities.agg(F.avg(F.octet_length("uid"))).first()[0] or 0)
    least = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(many, MOST, max(least, int(size / SHARE) + 1)))

    repos = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    before = repos.select("repo_id", (F.sum("n").over(Window.orderBy("repo_id")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file")) - 1
    files = files.withColumn("place", place).join(before, "repo_id").withColumn("slot", F.pmod(F.col("place") + F.col("before"), F.lit(slots)).cast("int")).drop("place", "before")
    at = files.select(F.col("repo_id").alias("__repo"), F.col("file").alias("__file"), "slot")
    at = F.broadcast(at) if many <= MOST else at
    whose = lambda rows: rows.join(at, F.col("repo_id").eqNullSafe(F.col("__repo")) & F.col("file").eqNullSafe(F.col("__file"))).drop("__repo", "__file")

    repo = entities.schema["repo_id"].dataType.simpleString()
    blank = {"uid": "string", "head": "string", "names": "array<string>", "targets": "array<struct<uid:string,file:string>>", "imports": "string", "dependencies": "string", "total_nodes": "long", "total_files": "long"}
    comma = lambda c: F.array_join(c, ",").alias(c)

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*KEY, "slot", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()))

    named = links.targets.groupBy("repo_id", "name").agg(F.collect_list(F.struct(F.col("dst_uid").alias("uid"), F.col("dst_file").alias("file"))).alias("targets"))
    named = named.select("repo_id", F.array("name").alias("names"), "targets").join(files.select(*KEY, "slot"), "repo_id")
    said = links.found.select("repo_id", F.col("src_file").alias("file"), F.col("src_uid").alias("uid"), F.col("said.name").alias("names"))
    parts = [
        rows(files.select(*KEY, "slot", comma("imports"), comma("dependencies"), "total_nodes", "total_files"), META),
        rows(named, TARGETS),
        rows(whose(entities.select(*KEY, "uid", head.alias("head"))), HEAD),
        rows(whose(said), SAID),
    ]
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).repartitionById(slots, F.col("slot"))
    dealt = dealt.sortWithinPartitions(*KEY, F.least("kind", F.lit(HEAD)), "uid", "kind").drop("slot")
    return dealt.mapInArrow(_texts, f"repo_id {repo}, file string, nodes string, imports string, dependencies string, total_nodes long, total_files long")


class _File:
    """The text of a file, as its nodes come by uid; its targets come before them."""

    def __init__(self, meta: dict):
        self.meta, self.text, self.lists, self.uids = meta, bytearray(), [], None
        self.head, self.said, self.nodes = None, [], 0

    def targets(self, names: pa.Array, targets: pa.Array) -> None:
        self.lists.append((names, targets))

    def _ready(self) -> None:
        """By name, the places of its targets in other files, in the order of all such uids."""
        names = pa.concat_arrays([n.flatten() for n, _ in self.lists]) if self.lists else pa.array([], pa.string())
        lists = pa.concat_arrays([t for _, t in self.lists]) if self.lists else pa.array([], pa.list_(pa.struct([("uid", pa.string()), ("file", pa.string())])))
        many, flat = np.asarray(pc.list_value_length(lists), np.int64), lists.flatten()
        far = np.asarray(pc.fill_null(pc.not_equal(flat.field("file"), pa.scalar(self.meta["file"], pa.string())), False), bool)
        owner = np.repeat(np.arange(len(names)), many)[far]
        uids = flat.field("uid").filter(pa.array(far))
        order = np.asarray(pc.sort_indices(uids), np.int64)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.many = np.bincount(owner, minlength=len(names))
        self.begin = np.cumsum(self.many) - self.many
        self.names, self.lists = names, None
        self.uids = [u.encode() for u in uids.take(pa.array(order)).to_pylist()]

    def found(self, names: pa.Array) -> np.ndarray:
        """The numbers of names; they are all among the targets'."""
        if self.uids is None:
            self._ready()
        return np.asarray(pc.index_in(names, value_set=self.names), np.int64)

    def node(self, head: str) -> None:
        self.end()
        self.head, self.said = head, []

    def end(self) -> None:
        """Writes the node that is open."""
        if self.head is None:
            return
        if self.nodes:
            self.text += b";"
        self.text += self.head.encode()
        self.text += b"|"
        if self.said:
            ids = np.concatenate(self.said)
            n = self.many[ids]
            edges = np.cumsum(n)
            at = np.repeat(self.begin[ids] - edges + n, n) + np.arange(edges[-1])
            self.text += b",".join(map(self.uids.__getitem__, np.sort(self.place[at]).tolist()))
        self.head, self.said, self.nodes = None, [], self.nodes + 1

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        self.end()
        text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(self.text)], np.int32)), pa.py_buffer(self.text))
        return pa.RecordBatch.from_arrays([text if f.name == "nodes" else pa.array([self.meta[f.name]], f.type) for f in schema], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a file of rows that come by file: what is told of the file, its repository's targets, and then its nodes with the names in their code."""
    now, schema = None, None
    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field("repo_id"), ("file", pa.string()), ("nodes", pa.string()), ("imports", pa.string()), ("dependencies", pa.string()), ("total_nodes", pa.int64()), ("total_files", pa.int64())])
        kinds = np.asarray(batch.column("kind"))
        # Runs of one kind of a file; heads and names take turns, so they are one.
        steps = np.flatnonzero(np.diff(np.minimum(kinds, HEAD)) != 0) + 1
        for a, b in zip([0, *steps], [*steps, len(kinds)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if kinds[a] == META:
                for meta in part.select([f.name for f in schema if f.name != "nodes"]).to_pylist():
                    if now is not None:
                        yield now.row(schema)
                    now = _File(meta)
            elif kinds[a] == TARGETS:
                now.targets(part.column("names"), part.column("targets"))
            else:
                names = part.column("names")
                ids = now.found(names.flatten())
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(names), 0), np.int64))
                heads, begin = part.column("head").to_pylist(), 0
                for kind, head, end in zip(kinds[a:b].tolist(), heads, ends.tolist(), strict=True):
                    if kind == HEAD:
                        now.node(head)
                    else:
                        now.said.append(ids[begin:end])
                    begin = end
    if now is not None:
        yield now.row(schema)
