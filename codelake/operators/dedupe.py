"""Removal of near-duplicates in order, in parallel: a row stays unless it is near one that stays before it.

That is the lexicographically first maximal independent set of the similarity graph, and is found in rounds. Rows are near only if they share some
of their first words under a global order (a prefix filter), so each row stands in the lists of these words. A round compares every list with the
first few rows in it. A row that is among the first of all of its lists has met all earlier rows that it could be near, so it is decided as soon
as these are; what is near a row that stays leaves. Each round takes twice as many rows of a list as the one before it, so lists of any length
end after a few rounds, and a crowd of near rows meets only the few of them that come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage

#: Rows of a list that the first round compares with the others.
FIRST = 8

#: Words that sets must share among their first ones before they are compared, where they have as many.
SHARED = 4

#: The words that most rows have stand last in the global order, as far as this many of them are known; it decides speed only.
KNOWN = 65_536


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def places(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """rows with `place`, from 1, of each in its group's order, which must be total. Groups are cut by ranges, so none is one task's work."""
    ranged = rows.repartitionByRange(group, *order)
    ranged = stage(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("__part", F.col(group).alias("__group")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("__part").alias("__p"), "__group", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order))
    met = ranged.withColumn("__own", own).join(parts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return met.withColumn("place", (F.col("__own") + F.col("__before")).cast("int")).drop("__part", "__own", "__p", "__group", "__before")


def greedy_dedupe(rows: DataFrame, group: str, order: list[str], text: str, threshold: float = 0.8, first: int = FIRST) -> DataFrame:
    """(group, idx, place): rows that aren't near one that was kept before them in the order of their group; place counts all of a group's rows.

    Two texts are near if the Jaccard similarity of their sets of lower-cased words is at least threshold; empty and null texts are near nothing.
    All rows count, and their whole texts. Rows that are equal in the order's columns come in the order of idx, and else in any.
    """
    words = F.array_sort(F.transform(word_set(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    keys = [*order, *({"idx"} - set(order))]
    named = rows.select(F.col(group).alias("group"), "idx", *(F.col(c).alias(f"o{i}") for i, c in enumerate(keys)), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    digest = [F.xxhash64("words").alias("d1"), F.xxhash64(F.lit(1), "words").alias("d2")]
    named = stage(named.select("*", F.size("words").alias("n"), *digest), "rows")  # the numbers stay as they are; words are written only here
    told = stage(places(named.drop("words"), "group", *(f"o{i}" for i in range(len(keys))), "row").select("group", "idx", "row", "place", "n", "d1", "d2"), "places")

    # Of equal sets only the first can stay, and it stands for all.
    once = told.where("n > 0").groupBy("group", "n", "d1", "d2").agg(F.min_by("row", "place").alias("row"), F.min("place").alias("place")).select("group", "row", "place", "n")
    once = stage(once, "sets")
    sets = named.select("row", "group", "n", "words").where("n > 0")
    common = sets.select(F.explode("words").alias("word")).groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(KNOWN).collect()
    # A word of a group is one number, and so are a set's size and how many of its words there are from the word on; rows are many.
    lists = once.join(_prefixes(sets, np.array([r["word"] for r in common], np.int64), threshold), "row")
    lists = lists.select("row", "group", "place", "n", F.posexplode("tokens").alias("at", "token"))
    lists = lists.select("row", F.xxhash64("group", "token").alias("list"), "place", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("n") - F.col("at")).alias("sizes"))
    lists = stage(lists, "lists")
    # A list of one row can be left out; rows without any list are near nothing.
    lists = stage(_shared(lists), "lists")
    gone = []
    while not lists.isEmpty():
        kept, removed = _round(lists, sets, threshold, first)
        gone.append(removed)
        lists, first = stage(lists.join(kept.unionByName(removed), "row", "left_anti"), "lists"), 2 * first
    out = told.join(once.select("row"), "row", "left_semi").unionByName(told.where("n = 0"))
    for part in gone:
        out = out.join(part, "row", "left_anti")
    return out.select(F.col("group").alias(group), "idx", "place")


def _prefixes(sets: DataFrame, common: np.ndarray, threshold: float) -> DataFrame:
    """(row, tokens): the first words of sets(row, n, words), rare ones first.

    Sets of n words that are near share at least ceil(threshold * n) words; under any one order of all words, the first SHARED of these stand among
    the first n - ceil(threshold * n) + SHARED of either. Here words come by how few rows have them, as far as that is known, then by their hash.
    """
    rank = np.argsort(common)
    known, weight = common[rank], len(common) - rank  # the commonest word has the largest weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            tokens = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                s = flat[a:b]
                often = np.zeros(len(s), np.int64)
                if len(known):
                    where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[where] == s, weight[where], 0)
                tokens.append(s[np.lexsort((s, often))[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + SHARED]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], names=["row", "tokens"])

    return sets.select("row", "words").mapInArrow(run, "row long, tokens array<long>")


def _shared(lists: DataFrame, bits: int = 26) -> DataFrame:
    """lists(list, ...) of more than one row, and a few others: all that fall on a place of a bitmap of fixed size (8 MB) that one of the former takes. So
    only the lists' numbers move, not their rows."""
    place = F.shiftrightunsigned("list", 64 - bits)
    row, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    taken = lists.groupBy("list").count().where("count > 1").select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    met = lists.withColumns({"__at": row, "__b": bit}).join(F.broadcast(stage(taken, "shared")), F.col("__at") == F.col("__row"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__b div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.where(F.expr("1 << cast(__b % 8 as int)").bitwiseAND(byte) != 0).select(*lists.columns)


def _round(lists: DataFrame, sets: DataFrame, threshold: float, first: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the lists that stay, and rows that leave; at least the first of each group is decided."""
    rank = F.row_number().over(Window.partitionBy("list").orderBy("place", "row"))
    heads = stage(lists.withColumn("__rank", rank).where(F.col("__rank") <= first).drop("__rank"), "heads")
    clear = lists.groupBy("row").agg(F.count("*").alias("all")).join(heads.groupBy("row").agg(F.count("*").alias("first")), "row").where("all = first").select("row")
    clear = stage(clear, "clear")

    # Only pairs with a clear row decide anything, and all lists that such a pair shares are met here.
    mark = clear.select("row", F.lit(True).alias("clear"))
    x, y = lists.join(mark, "row", "left").alias("x"), heads.join(mark, "row", "left").alias("y")
    same = (F.col("x.list") == F.col("y.list")) & (F.col("y.place") < F.col("x.place"))
    size = lambda side: F.shiftright(f"{side}.sizes", 32)
    ahead = lambda side: F.col(f"{side}.sizes").bitwiseAND(F.lit(0xFFFFFFFF))
    # So many words near sets share; behind each of the first SHARED of them there are the others.
    least = F.ceil(threshold / (1 + threshold) * (size("x") + size("y")) - 1e-9)
    fits = (F.least(size("x"), size("y")) >= F.lit(threshold) * F.greatest(size("x"), size("y")) - 1e-9) & (F.least(ahead("x"), ahead("y")) >= least - (SHARED - 1))
    pairs = x.join(y, same).where(F.coalesce("x.clear", "y.clear", F.lit(False)) & fits).groupBy(F.col("y.row").alias("src"), F.col("x.row").alias("dst"))
    pairs = pairs.agg(F.count("*").alias("both"), F.first(least).alias("least")).where(F.col("both") >= F.least("least", F.lit(SHARED))).select("src", "dst")
    pairs = stage(pairs, "pairs")
    asked = pairs.select(F.col("src").alias("row")).unionByName(pairs.select(F.col("dst").alias("row"))).distinct()
    own = sets.join(asked, "row", "left_semi")
    a, b = (own.select(F.col("row").alias(end), F.col("group").alias(f"{end}_group"), F.col("words").alias(words)) for end, words in (("src", "w1"), ("dst", "w2")))
    both = F.size(F.array_intersect("w1", "w2"))
    near = both >= F.lit(threshold) * (F.size("w1") + F.size("w2") - both)
    edges = stage(pairs.join(a, "src").join(b, "dst").where(near & F.col("src_group").eqNullSafe(F.col("dst_group"))).select("src", "dst"), "edges")

    open_, kept, removed = clear, [], []
    while True:
        stay = stage(open_.join(edges.select(F.col("dst").alias("row")), "row", "left_anti"), "kept")
        if stay.isEmpty():
            break
        leave = stage(edges.join(stay.select(F.col("row").alias("src")), "src", "left_semi").select(F.col("dst").alias("row")).distinct(), "removed")
        kept.append(stay)
        removed.append(leave)
        done = stay.unionByName(leave)
        edges = stage(edges.join(done.select(F.col("row").alias("src")), "src", "left_anti").join(done.select(F.col("row").alias("dst")), "dst", "left_anti"), "edges")
        open_ = stage(open_.join(done, "row", "left_anti"), "clear")
    out = []
    for parts in (kept, removed):
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        out.append(whole)
    return out[0], out[1]
