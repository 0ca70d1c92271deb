"""Graph construction and graph queries over entities(repo_id, file, name, type, start_line, end_line, raw_code, uid) and calls(repo_id, src_uid, dst_uid).

Questions take calls as a table or as Links (links.py), which spares making them.

Each function takes and gives DataFrames. Where the order of a limit isn't told by the question, the uid decides, so results are the same in any run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..sources.store import stage
from .links import Links

#: Types that can be called, the length above which a name is told apart from noise, and names that need no caller.
TARGET_TYPES = ("Function", "Class", "Struct", "Interface", "Resource", "Variable")
MIN_NAME = 3
ENTRY_NAMES = ("main", "index", "__init__", "handler", "default")


#: Functions that are searched together, and names that an automaton holds.
BLOCK, PART = 500, 50_000
#: Nodes of a file that are searched together.
WITHIN = 1000


def callable_names(entities: DataFrame) -> DataFrame:
    """(repo_id, name): the distinct names of a repository that code may call."""
    return entities.where(F.col("type").isin(*TARGET_TYPES) & (F.char_length("name") > MIN_NAME)).select("repo_id", "name").distinct()


def mentions(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(repo_id, src_uid, src_file, name): the functions of entities whose code contains a name of names(repo_id, name) of their repository, once each.

    A repository's functions are cut into blocks and its names into parts, and each block meets each part in a task of its own: the part's
    names become one automaton, which passes over each text once. So texts are shuffled once for each 50,000 names of their repository, no
    row is made for what doesn't match, and no repository is too large for a task. Names that are empty or null are found nowhere.
    """
    code, asked = cells(entities, names.select("repo_id", "name"))
    schema = f"repo_id {names.schema['repo_id'].dataType.simpleString()}, src_uid string, src_file string, names array<string>"
    found = code.cogroup(asked).applyInArrow(_search, schema)
    return found.select("repo_id", "src_uid", "src_file", F.explode("names").alias("name"))


def cells(entities: DataFrame, names: DataFrame) -> tuple[GroupedData, GroupedData]:
    """The functions of entities and names(repo_id, name, ...), each grouped by the cells where they meet; names' columns begin with of_."""
    code = entities.where((F.col("type") == "Function") & F.col("raw_code").isNotNull()).select("repo_id", F.col("uid").alias("src_uid"), F.col("file").alias("src_file"), "raw_code")
    names = names.where("name <> ''")
    blocks = code.groupBy("repo_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = blocks.join(names.groupBy("repo_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "repo_id")
    dealt = code.join(sizes, "repo_id").withColumn("block", F.pmod(F.xxhash64("src_uid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("repo_id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src_uid", "src_file", "raw_code")
    asked = names.join(sizes, "repo_id").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    # Names of their own for one side's columns, as both come from the same entities.
    more = [F.col(c).alias(f"of_{c}") for c in names.columns if c != "repo_id"]
    asked = asked.select(F.col("repo_id").alias("of_repo"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"), F.col("part").alias("of_part"), *more)
    return dealt.groupBy("repo_id", "block", "part"), asked.groupBy("of_repo", "of_block", "of_part")


def _search(code: pa.Table, names: pa.Table) -> pa.Table:
    """The names that each code contains, of one cell."""
    import ahocorasick

    wanted, found = names.column("of_name").to_pylist(), []
    if wanted and code.num_rows:
        automaton = ahocorasick.Automaton()
        for i, name in enumerate(wanted):
            automaton.add_word(name, i)
        automaton.make_automaton()
        found = [[wanted[i] for i in {i for _, i in automaton.iter(text.as_py())}] for text in code.column("raw_code")]
    rows = code.select(["repo_id", "src_uid", "src_file"])
    return rows.append_column("names", pa.array(found or [[]] * code.num_rows, pa.list_(pa.string())))


def resolve(mentioned: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, src_uid, dst_uid): what mentions stand for, the entities of that name in other files of the repository."""
    targets = entities.where(F.col("type").isin(*TARGET_TYPES)).select("repo_id", "name", F.col("uid").alias("dst_uid"), F.col("file").alias("dst_file"))
    pairs = mentioned.join(targets, ["repo_id", "name"]).where("src_uid <> dst_uid and src_file <> dst_file")
    return pairs.select("repo_id", "src_uid", "dst_uid")


def link_dependencies(entities: DataFrame) -> DataFrame:
    """(repo_id, src_uid, dst_uid): functions whose code contains the name of an entity of another file in the repository; uids are unique, and so
    are the pairs."""
    return resolve(mentions(entities, callable_names(entities)), entities)


def relink(before: DataFrame, after: DataFrame, mentioned: DataFrame, calls: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and calls of the entities `after`, from those of the entities `before` and the files changed(repo_id, file), gone ones included.

    Only the functions of changed files are searched for all names, and the others for names that weren't there before; only calls with an end in
    a changed file are made anew. The result is that of linking everything. All rows are of the changed repositories.
    """
    file = ["repo_id", "file"]
    inside, outside = after.join(changed, file, "left_semi"), after.join(changed, file, "left_anti")
    old, new = callable_names(before), callable_names(after)
    own = mentions(inside, new)
    fresh = mentions(outside, new.join(old, ["repo_id", "name"], "left_anti"))
    gone = old.join(new, ["repo_id", "name"], "left_anti")
    kept = mentioned.join(changed.withColumnRenamed("file", "src_file"), ["repo_id", "src_file"], "left_anti").join(gone, ["repo_id", "name"], "left_anti")
    others = kept.unionByName(fresh)

    dropped = before.join(changed, file, "left_semi").select("uid")
    stay = calls.join(dropped.withColumnRenamed("uid", "src_uid"), "src_uid", "left_anti").join(dropped.withColumnRenamed("uid", "dst_uid"), "dst_uid", "left_anti")
    made = resolve(own, after).unionByName(resolve(others, inside))
    columns = ["repo_id", "src_uid", "src_file", "name"]
    return others.unionByName(own).select(columns), stay.select("repo_id", "src_uid", "dst_uid").unionByName(made)


def _ends(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Calls with name, file, type and line of both ends; the code stays behind. Calls that carry their ends (sources/layout.py) are taken as they are."""
    if "src_name" in calls.columns:
        return calls
    at = lambda p: entities.select("repo_id", F.col("uid").alias(f"{p}_uid"), *(F.col(c).alias(f"{p}_{c}") for c in ("name", "file", "type", "start_line")))
    return calls.join(at("src"), ["repo_id", "src_uid"]).join(at("dst"), ["repo_id", "dst_uid"])


def callees_near_line(entities: DataFrame, calls: DataFrame | Links, line: int, per_source: int = 5, repo_id: str | None = None, file: str | None = None) -> DataFrame:
    """What the entities that start within a line of `line` call, at most `per_source` for each; of all files, or of one repository or file."""
    own = entities.where(F.abs(F.col("start_line") - line) <= 1)
    own = own if repo_id is None else own.where(F.col("repo_id") == repo_id)
    own = own if file is None else own.where(F.col("file") == file)
    own = own.select("repo_id", F.col("uid").alias("src_uid"), F.col("file").alias("src_file"))
    if isinstance(calls, Links):
        calls = calls.callees(per_source).select("repo_id", "src_uid", F.explode("first.uid").alias("dst_uid"))
    found = own.join(calls, ["repo_id", "src_uid"]).join(entities.select(F.col("uid").alias("dst_uid"), "name", "type", "file"), "dst_uid")
    rank = F.row_number().over(Window.partitionBy("src_uid").orderBy("dst_uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= per_source).select("src_uid", "dst_uid", "name", "type", "file")


def file_entities(entities: DataFrame, limit: int = 10) -> DataFrame:
    """The first entities of each file, by line."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "file").orderBy("start_line", "uid"))
    return entities.select("repo_id", "file", "name", "type", "start_line", "uid").withColumn("rank", rank).where(F.col("rank") <= limit)


def callers_of(entities: DataFrame, calls: DataFrame | Links, limit: int = 10) -> DataFrame:
    """Callers of each name in a repository (homonyms together), at most `limit` for each."""
    found = callers_by_name(entities, calls, limit)
    return found.select("repo_id", "name", F.col("src_name").alias("caller"), F.col("src_file").alias("caller_file"), "rank", F.lit("calls").alias("relationship"))


def callers_by_name(entities: DataFrame, calls: DataFrame | Links, limit: int) -> DataFrame:
    """(repo_id, name, src_name, src_file, src_start_line, rank): the first `limit` calls of each name in a repository, by the uids of their ends."""
    columns = ("repo_id", "name", "src_name", "src_file", "src_start_line", "rank")
    if isinstance(calls, Links):
        at = calls.entities.select(F.col("uid").alias("src_uid"), *(F.col(c).alias(f"src_{c}") for c in ("name", "file", "start_line")))
        return calls.callers_by_name(limit).join(at, "src_uid").select(*columns)
    rank = F.row_number().over(Window.partitionBy("repo_id", "dst_name").orderBy("src_uid", "dst_uid"))
    return _ends(calls, entities).withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("name", F.col("dst_name")).select(*columns)


def call_chains(calls: DataFrame | Links, starts: DataFrame, depth: int = 3, limit: int = 10) -> DataFrame:
    """(repo_id, depth, path) of the trails from starts(repo_id, src_uid): up to `depth` calls, none used twice; the first `limit` of each repository.

    A uid names its repository, so calls are met by it alone: where they lie by src_uid, only the trails move. A repository whose `limit` is full
    goes no deeper, so no level leaves more than that many trails of it; those are written, and counted before calls are met with them.
    """
    laid = not isinstance(calls, Links) and "src_name" in calls.columns
    trails = starts.select("repo_id", F.col("src_uid").alias("at"), F.array("src_uid").alias("nodes"), F.array().cast("array<string>").alias("used"), F.lit("").alias("path"))
    first = Window.partitionBy("repo_id").orderBy("path")
    levels, open_ = [], trails
    for level in range(1, depth + 1):
        open_ = open_ if laid else stage(open_, "trails")
        edges = calls.calls_from(open_.select(F.col("at").alias("src_uid"))) if isinstance(calls, Links) else calls
        edge = edges.select(F.col("src_uid").alias("at"), F.col("dst_uid").alias("next"))
        # Calls are never the side that goes to all tasks, however small their files are.
        step = _met_by_few(open_, edge, laid)
        name = F.concat_ws("->", "at", "next")
        nodes = F.array_append("nodes", F.col("next"))
        step = step.where(~F.array_contains("used", name)).select("repo_id", F.col("next").alias("at"), nodes.alias("nodes"), F.array_append("used", name).alias("used"), F.array_join(nodes, " > ").alias("path"))
        step = step.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit).drop("rank")
        step = step if level == depth else stage(step, "trails")
        levels.append(step.select("repo_id", F.lit(level).alias("depth"), "path"))
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        full = found.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        open_ = step.join(full, "repo_id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("depth", "path"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("repo_id", "depth", "path")


#: Trails that may go to every task.
FEW = 10_000


def _met_by_few(trails: DataFrame, edge: DataFrame, laid: bool) -> DataFrame:
    if laid:
        return trails.join(edge.hint("merge"), "at")
    few = trails.limit(FEW + 1).count() <= FEW
    return F.broadcast(trails).join(edge, "at") if few else trails.join(edge.hint("merge"), "at")


def file_dependencies(entities: DataFrame, calls: DataFrame | Links) -> DataFrame:
    """(repo_id, file, depends_on, calls): how often a file calls into each other file."""
    if isinstance(calls, Links):
        return calls.by_file().select("repo_id", F.col("src_file").alias("file"), F.col("dst_file").alias("depends_on"), "calls")
    ends = _ends(calls, entities).where("src_file <> dst_file")
    return ends.groupBy("repo_id", F.col("src_file").alias("file"), F.col("dst_file").alias("depends_on")).agg(F.count("*").alias("calls"))


def similar_names(entities: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """For names(repo_id, fn): functions whose name contains its term (the name without get, set and _), or whose name the term contains.

    Different names and terms of a repository meet in an equi-join on up to three characters that one begins with and the other contains; an
    empty one meets all. Only the first `limit` functions of a name can be among those of a term, so no more of them meet it.
    """
    functions = entities.where("type = 'Function'").select("repo_id", "name", "file", "uid")
    first = Window.partitionBy("repo_id", "name").orderBy("uid")
    functions = functions.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place")
    term = F.replace(F.replace(F.replace("fn", F.lit("get"), F.lit("")), F.lit("set"), F.lit("")), F.lit("_"), F.lit(""))
    asked = names.select("repo_id", "fn").distinct().withColumn("term", term)
    terms, own = asked.select("repo_id", "term").distinct(), functions.select("repo_id", "name").distinct()
    held = _met(own, "name", terms, "term").withColumn("longer", F.lit(False))
    holds = _met(terms, "term", own, "name").select("repo_id", "name", "term", F.lit(True).alias("longer"))
    # A name that equals the term meets it from both sides; only the first leaves its own function in.
    met = held.unionByName(holds).groupBy("repo_id", "term", "name").agg(F.min("longer").alias("longer"))
    near = met.join(asked, ["repo_id", "term"]).where(~F.col("longer") | (F.col("name") != F.col("fn"))).select("repo_id", "fn", "name")
    rank = F.row_number().over(Window.partitionBy("repo_id", "fn").orderBy("uid"))
    return near.join(functions, ["repo_id", "name"]).withColumn("rank", rank).where(F.col("rank") <= limit).select("repo_id", "fn", "name", "file", "rank")


def _met(long: DataFrame, text: str, short: DataFrame, part: str, size: int = 3) -> DataFrame:
    """(repo_id, text, part) of all pairs in which text contains part."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))

    def grams(n: int) -> Column:
        return F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(n)))

    cut = long.select("repo_id", text, F.explode(F.array_distinct(F.concat(*map(grams, range(size + 1))))).alias("gram"))
    return cut.join(short.withColumn("gram", F.substring(part, 1, size)), ["repo_id", "gram"]).where(F.contains(text, part)).select("repo_id", text, part)


def fanout(calls: DataFrame | Links) -> DataFrame:
    """(repo_id, src_uid, calls): how many entities each function calls."""
    return calls.fanout() if isinstance(calls, Links) else calls.groupBy("repo_id", "src_uid").agg(F.count("*").alias("calls"))


def fanin(calls: DataFrame | Links) -> DataFrame:
    """(repo_id, dst_uid, calls): how many functions call each entity."""
    return calls.fanin().drop("dst_file") if isinstance(calls, Links) else calls.groupBy("repo_id", "dst_uid").agg(F.count("*").alias("calls"))


def calls_by_name(entities: DataFrame, calls: DataFrame | Links) -> DataFrame:
    """(repo_id, name, calls): how many calls the entities of a name have."""
    return calls.by_name() if isinstance(calls, Links) else _ends(calls, entities).groupBy("repo_id", F.col("dst_name").alias("name")).agg(F.count("*").alias("calls"))


def fanout_hotspots(calls: DataFrame | Links, min_calls: int = 5, limit: int = 10) -> DataFrame:
    """The functions that call most others, at least min_calls."""
    counted = fanout(calls).where(F.col("calls") >= min_calls)
    return counted.orderBy(F.desc("calls"), "repo_id", "src_uid").limit(limit)


def coupled_files(entities: DataFrame, calls: DataFrame | Links, min_calls: int = 5, limit: int = 10) -> DataFrame:
    """Pairs of files with most calls from one to the other, at least min_calls."""
    found = file_dependencies(entities, calls).where(F.col("calls") >= min_calls)
    return found.orderBy(F.desc("calls"), "repo_id", "file", "depends_on").limit(limit)


def unused_functions(entities: DataFrame, calls: DataFrame | Links, limit: int | None = 20) -> DataFrame:
    """Functions that nothing calls, but for entry points; the first `limit` of each repository, by file and line."""
    own = entities.where((F.col("type") == "Function") & ~F.col("name").isin(*ENTRY_NAMES)).select("repo_id", "file", "name", "start_line", "uid")
    called = (calls.fanin() if isinstance(calls, Links) else calls).select(F.col("dst_uid").alias("uid"))
    left = own.join(called, "uid", "left_anti")
    if limit is None:
        return left
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("file", "start_line", "uid"))
    return left.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def repo_node_count(entities: DataFrame) -> DataFrame:
    """Files and entities of each repository."""
    return entities.groupBy("repo_id").agg((F.count("*") + F.countDistinct("file")).alias("nodes"))


def relationship_census(entities: DataFrame, calls: DataFrame | Links, imports: DataFrame) -> DataFrame:
    """(repo_id, relationship, relationships): how many of each kind a repository has; files contain entities, entities call, files import(repo_id, file, depends_on)."""
    kinds = (entities, "CONTAINS"), (calls, "CALLS"), (imports, "IMPORTS")
    if isinstance(calls, Links):
        counted = {"CALLS": calls.fanout().groupBy("repo_id").agg(F.sum("calls").alias("relationships"))}
        kinds = kinds[0], kinds[2]
    else:
        counted = {}
    counted |= {kind: rows.groupBy("repo_id").agg(F.count("*").alias("relationships")) for rows, kind in kinds}
    parts = [rows.select("repo_id", F.lit(kind).alias("relationship"), "relationships") for kind, rows in counted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def entity_census(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.countDistinct("repo_id", "file").alias("files"))


def intra_file_calls(nodes: DataFrame) -> DataFrame:
    """Ordered pairs of different nodes(repo_id, file, uid, name, code) of a file where the first one's code contains the second one's name.

    A file's nodes are cut into blocks and its names into parts, each two of which meet in a task of their own, where the names become one automaton
    that passes over each text once, so no pair is compared. The rows are those pairs that match.
    """
    key = ["repo_id", "file"]
    nodes = nodes.where("repo_id is not null and file is not null")
    held = stage(nodes.select(*key, "uid", "name"), "nodes")  # the code is read once
    code = nodes.where("code is not null").select(*key, F.col("uid").alias("src_uid"), "code")
    names = held.where("name is not null").groupBy(*key, "name").agg(F.collect_list("uid").alias("uids"))
    sizes = held.groupBy(*key).agg(F.ceil(F.count("*") / WITHIN).cast("int").alias("blocks"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = code.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("src_uid"), F.col("blocks")).cast("int"))
    dealt = dealt.select(*key, "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src_uid", "code")
    asked = names.join(sizes, key).withColumn("of_part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    asked = asked.select(F.col("repo_id").alias("of_repo"), F.col("file").alias("of_file"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"), "of_part", F.col("name").alias("of_name"), F.col("uids").alias("of_uids"))
    types = {c: nodes.schema[c].dataType.simpleString() for c in (*key, "uid")}
    schema = f"repo_id {types['repo_id']}, file {types['file']}, src_uid {types['uid']}, dst_uids array<{types['uid']}>"
    found = dealt.groupBy(*key, "block", "part").cogroup(asked.groupBy("of_repo", "of_file", "of_block", "of_part")).applyInArrow(_within, schema)
    return found.select(*key, "src_uid", F.explode("dst_uids").alias("dst_uid")).where("src_uid <> dst_uid")


def _within(code: pa.Table, names: pa.Table) -> pa.Table:
    """The uids whose names each code contains, of one cell."""
    import ahocorasick

    rows = code.select(["repo_id", "file", "src_uid"])
    uids = names.column("of_uids").combine_chunks()
    if not code.num_rows or not names.num_rows:
        return rows.slice(0, 0).append_column("dst_uids", pa.array([], uids.type))
    automaton, always = ahocorasick.Automaton(), []  # no automaton holds the empty name, which lies in all code
    for i, name in enumerate(names.column("of_name").to_pylist()):
        if name:
            automaton.add_word(name, i)
        else:
            always.append(i)
    automaton.make_automaton()
    search = automaton.iter if len(automaton) else lambda text: ()
    sets = ({*always, *(i for _, i in search(text.as_py()))} for text in code.column("code"))
    found = [np.fromiter(ids, np.int64, len(ids)) for ids in sets]
    many, flat = np.asarray(pc.list_value_length(uids), np.int64), uids.flatten()
    begin, ids = np.cumsum(many) - many, np.concatenate(found)
    edge = np.concatenate([[0], np.cumsum([many[x].sum() for x in found])])
    n = many[ids]
    at = np.repeat(begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return rows.append_column("dst_uids", pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat.take(pa.array(at))))


def import_dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports(repo_id, file, import) that are the path of a file of the repository."""
    return imports.join(files.select("repo_id", F.col("file").alias("import")).distinct(), ["repo_id", "import"]).select("repo_id", "file", F.col("import").alias("depends_on"))


def impacted_callers(entities: DataFrame, calls: DataFrame | Links) -> DataFrame:
    """Distinct callers of anything in a file, from other files."""
    if isinstance(calls, Links):
        return calls.used_files().select("repo_id", F.col("dst_file").alias("file"), F.col("src_uid").alias("caller"))
    ends = _ends(calls, entities).where("src_file <> dst_file")
    return ends.select("repo_id", F.col("dst_file").alias("file"), F.col("src_uid").alias("caller")).distinct()


def delete_files(entities: DataFrame, calls: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and calls without those of the files in gone(repo_id, file)."""
    left = entities.join(gone, ["repo_id", "file"], "left_anti")
    dropped = entities.join(gone, ["repo_id", "file"], "left_semi").select("uid")
    kept = calls.join(dropped.withColumnRenamed("uid", "src_uid"), "src_uid", "left_anti").join(dropped.withColumnRenamed("uid", "dst_uid"), "dst_uid", "left_anti")
    return left, kept


def last_captured(new: DataFrame) -> DataFrame:
    """Of the rows of one uid the last captured one (new needs capture_idx, which is left out)."""
    last = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("capture_idx"), F.desc("start_line"), F.desc("end_line"), "type", "raw_code"))
    return new.withColumn("rn", last).where("rn = 1").drop("rn", "capture_idx")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after new files replace old ones; of one uid the last captured row stays (new needs capture_idx)."""
    return old.join(new.select("repo_id", "file").distinct(), ["repo_id", "file"], "left_anti").unionByName(last_captured(new))
