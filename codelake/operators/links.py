"""Calls by what code says: a function mentions a name once, however many entities bear it.

Calls are mentions times homonyms, and both grow with a repository. Counts, first rows and files of calls follow from the mentions and from how many
entities of a name lie in which file, so most questions never make the calls. `Links` answers them; the functions of graph.py and context.py take it
in place of a table of calls and give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage

#: Callees of a function that are kept with it, the first by uid; whoever asks for more goes by all calls.
FIRST = 5
FOUND = "repo_id {repo}, src_uid string, src_file string, said array<struct<name:string,others:int>>, files array<string>, first array<struct<uid:string,name:string,file:string>>"


@dataclass(frozen=True)
class Links:
    """entities, without their code, and found: for each function and part of the names that it was searched for a row with the names in its code
    that entities of other files bear (said, with how many do), those files, and the first of those entities by uid. Both are staged. spread: the same names a row each, where they are kept so (sources/layout.py)."""

    entities: DataFrame
    found: DataFrame
    spread: DataFrame | None = None

    @cached_property
    def targets(self) -> DataFrame:
        from . import graph

        return self.entities.where(F.col("type").isin(*graph.TARGET_TYPES) & (F.char_length("name") > graph.MIN_NAME)).select("repo_id", "name", F.col("uid").alias("dst_uid"), F.col("file").alias("dst_file"))

    @property
    def mentioned(self) -> DataFrame:
        """(repo_id, src_uid, src_file, name, others)."""
        return self.found.select("repo_id", "src_uid", "src_file", F.inline("said")) if self.spread is None else self.spread

    @property
    def calls(self) -> DataFrame:
        """(repo_id, src_uid, dst_uid): all of them."""
        return self._resolved(self.mentioned)

    def calls_from(self, sources: DataFrame) -> DataFrame:
        """The calls of sources(src_uid)."""
        return self._resolved(self.found.join(sources, "src_uid", "left_semi").select("repo_id", "src_uid", "src_file", F.inline("said")))

    def _resolved(self, mentioned: DataFrame) -> DataFrame:
        return mentioned.join(self.targets, ["repo_id", "name"]).where("src_file <> dst_file").select("repo_id", "src_uid", "dst_uid")

    @cached_property
    def counted(self) -> DataFrame:
        """(repo_id, src_file, name, n, others): how many functions of a file mention a name. Staged: no larger than files times names."""
        return stage(self.mentioned.groupBy("repo_id", "src_file", "name").agg(F.count("*").alias("n"), F.first("others").alias("others")), "counted")

    def fanout(self) -> DataFrame:
        """(repo_id, src_uid, calls)."""
        n = F.aggregate("said", F.lit(0).cast("long"), lambda a, x: a + x["others"])
        return self.found.groupBy("repo_id", "src_uid").agg(F.sum(n).alias("calls"))

    def fanin(self) -> DataFrame:
        """(repo_id, dst_uid, dst_file, calls) of entities that are called: all who mention the name, but for those of the entity's own file."""
        every = self.counted.groupBy("repo_id", "name").agg(F.sum("n").alias("every"))
        own = self.counted.select("repo_id", "name", F.col("src_file").alias("dst_file"), F.col("n").alias("own"))
        met = self.targets.join(every, ["repo_id", "name"]).join(own, ["repo_id", "name", "dst_file"], "left")
        return met.select("repo_id", "dst_uid", "dst_file", (F.col("every") - F.coalesce("own", F.lit(0))).alias("calls")).where("calls > 0")

    def by_name(self) -> DataFrame:
        """(repo_id, name, calls): the calls of all entities of a name."""
        return self.counted.groupBy("repo_id", "name").agg(F.sum(F.col("n") * F.col("others")).alias("calls"))

    def by_file(self) -> DataFrame:
        """(repo_id, src_file, dst_file, calls)."""
        held = self.targets.groupBy("repo_id", "name", "dst_file").agg(F.count("*").alias("held"))
        met = self.counted.join(held, ["repo_id", "name"]).where("src_file <> dst_file")
        return met.groupBy("repo_id", "src_file", "dst_file").agg(F.sum(F.col("n") * F.col("held")).alias("calls"))

    def used_files(self) -> DataFrame:
        """(repo_id, src_uid, dst_file), once each."""
        return self.found.select("repo_id", "src_uid", F.explode("files").alias("dst_file")).distinct()

    def callees(self, most: int) -> DataFrame:
        """(repo_id, src_uid, src_file, first, files): the first `most` callees of each function by uid, as structs of uid, name and file, and the files of all, sorted."""
        key = ["repo_id", "src_uid", "src_file"]
        first = F.flatten(F.collect_list("first"))
        out = self.found.groupBy(*key).agg(F.slice(F.array_sort(first), 1, most).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
        if most <= FIRST:
            return out
        ends = self.calls.join(self.targets.drop("repo_id"), "dst_uid")
        ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("src_uid").orderBy("dst_uid"))).where(F.col("rank") <= most)
        more = ranked.groupBy("src_uid").agg(F.array_sort(F.collect_list(F.struct(F.col("dst_uid").alias("uid"), "name", F.col("dst_file").alias("file")))).alias("first"))
        return out.drop("first").join(more, "src_uid").select(*key, "first", "files")

    def callers_by_name(self, most: int) -> DataFrame:
        """(repo_id, name, src_uid, rank): the first `most` calls of each name by src_uid and dst_uid; one that calls several entities of it stands so often."""
        name = Window.partitionBy("repo_id", "name")
        first = self.mentioned.withColumn("rank", F.row_number().over(name.orderBy("src_uid"))).where(F.col("rank") <= most)
        calls = first.select("repo_id", "name", "src_uid", F.explode(F.sequence(F.lit(1), F.least("others", F.lit(most)))).alias("i"))
        return calls.withColumn("rank", F.row_number().over(name.orderBy("src_uid", "i"))).where(F.col("rank") <= most).drop("i")

    def callers(self, of: DataFrame, most: int) -> DataFrame:
        """(repo_id, dst_uid, src_uid, rank): the first `most` callers by uid of each of the entities of(repo_id, uid)."""
        asked = self.targets.join(of.select("repo_id", F.col("uid").alias("dst_uid")), ["repo_id", "dst_uid"], "left_semi")
        said = self.mentioned.join(asked.select("repo_id", "name"), ["repo_id", "name"], "left_semi")
        file = Window.partitionBy("repo_id", "name", "src_file").orderBy("src_uid")
        first = said.withColumn("rank", F.row_number().over(file)).where(F.col("rank") <= most).drop("rank")
        met = first.join(asked, ["repo_id", "name"]).where("src_file <> dst_file").select("repo_id", "dst_uid", "src_uid")
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", "dst_uid").orderBy("src_uid"))).where(F.col("rank") <= most)


def find_links(entities: DataFrame) -> Links:
    """The links of entities; uids are unique. Each function is searched once for the names of its repository, as in graph.mentions."""
    from . import graph

    held = stage(entities.drop("raw_code"), "entities")
    repo = held.schema["repo_id"].dataType.simpleString()
    links = Links(held, held)
    names = links.targets.groupBy("repo_id", "name").agg(F.collect_list(F.struct(F.col("dst_uid").alias("uid"), F.col("dst_file").alias("file"))).alias("targets"))
    code, asked = graph.cells(entities, names)
    return Links(held, stage(code.cogroup(asked).applyInArrow(search(FIRST), FOUND.format(repo=repo)), "links"))


def search(first: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What Links.found says of the functions of one cell."""

    def run(code: pa.Table, names: pa.Table) -> pa.Table:
        import ahocorasick

        automaton, wanted = ahocorasick.Automaton(), names.column("of_name").combine_chunks()
        for i, name in enumerate(wanted.to_pylist()):
            automaton.add_word(name, i)
        if not len(wanted):
            return _packed(code, [], wanted, [], [], [], [], None, None, first)
        automaton.make_automaton()
        lists = names.column("of_targets").combine_chunks()
        targets, many = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
        begin = np.cumsum(many) - many
        files = pc.dictionary_encode(targets.field("file"))
        file_of, number = np.asarray(files.indices, np.int64), {f: i for i, f in enumerate(files.dictionary.to_pylist())}
        order = np.asarray(pc.sort_indices(targets.field("uid")), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rows, said, others, used, best = [], [], [], [], []
        for row, (text, file) in enumerate(zip(code.column("raw_code"), code.column("src_file").to_pylist(), strict=True)):
            ids = np.array(sorted({i for _, i in automaton.iter(text.as_py())}), np.int64)
            if not len(ids):
                continue
            n, edges = many[ids], np.cumsum(many[ids])
            at = np.repeat(begin[ids] - edges + n, n) + np.arange(edges[-1])
            far = file_of[at] != number.get(file, -1)
            count = np.add.reduceat(far, edges - n, dtype=np.int64)
            if not count.any():
                continue
            ranks = rank[at[far]]
            ranks = np.partition(ranks, first - 1)[:first] if len(ranks) > first else ranks
            rows.append(row)
            said.append(ids[count > 0])
            others.append(count[count > 0])
            used.append(np.unique(file_of[at[far]]))
            best.append(order[np.sort(ranks)])
        owner = np.repeat(np.arange(len(wanted)), many)
        return _packed(code, rows, wanted, said, others, used, best, files.dictionary, (targets, owner), first)

    return run


def _packed(code, rows, wanted, said, others, used, best, files, targets, first) -> pa.Table:
    kind = pa.schema([("said", pa.list_(pa.struct([("name", pa.string()), ("others", pa.int32())]))), ("files", pa.list_(pa.string())), ("first", pa.list_(pa.struct([("uid", pa.string()), ("name", pa.string()), ("file", pa.string())])))])
    out = code.select(["repo_id", "src_uid", "src_file"]).take(pa.array(rows, pa.int64()))
    if not rows:
        for field in kind:
            out = out.append_column(field, pa.array([], field.type))
        return out
    joined = lambda parts: pa.array(np.concatenate(parts))
    bounds = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
    at, owner = np.concatenate(best), targets[1]
    columns = (
        pa.ListArray.from_arrays(bounds(said), pa.StructArray.from_arrays([wanted.take(joined(said)), joined(others).cast(pa.int32())], names=["name", "others"])),
        pa.ListArray.from_arrays(bounds(used), files.take(joined(used))),
        pa.ListArray.from_arrays(bounds(best), pa.StructArray.from_arrays([targets[0].field("uid").take(pa.array(at)), wanted.take(pa.array(owner[at])), targets[0].field("file").take(pa.array(at))], names=["uid", "name", "file"])),
    )
    for field, column in zip(kind, columns, strict=True):
        out = out.append_column(field, column.cast(field.type))
    return out
