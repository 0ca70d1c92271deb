"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are the same without the characters of [\\x20\\x09-\\x0D]. Rows are grouped by the length of what remains and the
hash of its beginning; only those that share such a group with another row go on to a digest of the whole. Which groups these are is told by a
bitmap of fixed size, which every task gets; it may let a row through that is alone, never stop one that isn't, and the digests decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stage_table

BLANKS = " \t\n\x0b\x0c\r"

#: Characters whose hash makes the second level.
PREFIX = 64

#: log2 of the bitmap's bits (8 MB), and of those of one of its rows.
BITS, ROW_BITS = 26, 15


def normalised(text: Column) -> Column:
    """The text (null: empty) without blanks."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id_col, keep_id, group_size long, kept boolean, digest string): one row for each row of docs, in any order.

    Of equal texts (null counts as empty) the row with the most code points in its original text stays, among those the one with the smallest
    id, null last. Repeated rows of one id and text are one document: they share a verdict, and each counts in group_size. digest is the
    sha-256 of the normalised text; it is null for rows that no other row could equal, unless digest_all asks for every row's. Other columns
    are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("chars"), normalised(F.col(text_col)).alias("content"))
    # Both levels in one aggregate, which counts before it moves: a length that occurs once has no beginning that occurs twice.
    group = F.xxhash64(F.octet_length("content"), F.xxhash64(F.substring("content", 1, PREFIX)))
    place = F.shiftrightunsigned(group, 64 - BITS)
    row, bit = F.shiftright(place, ROW_BITS), place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    shared = rows.groupBy(group.alias("g")).count().where("count > 1").select(F.shiftrightunsigned("g", 64 - BITS).alias("place"))
    bits = shared.groupBy(F.shiftright("place", ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits"))
    bits = stage_table(bits, "suspects")

    marked = rows.withColumns({"row": row, "bit": bit}).join(F.broadcast(bits), "row", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    suspect = F.coalesce(F.expr("bits is not null") & (F.expr("1 << cast(bit % 8 as int)").bitwiseAND(byte) != 0), F.lit(False))
    digest = F.sha2("content", 256)
    hashed = marked.withColumn("suspect", suspect).select("id", "chars", "suspect", (digest if digest_all else F.when(F.col("suspect"), digest)).alias("digest"))

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))
    groups = hashed.where("suspect").groupBy(F.col("digest").alias("group")).agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = stage_table(groups.select("group", F.col("best.id").alias("best_id"), "n"), "copies")
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = join_groups(hashed, groups, F.when(F.col("suspect"), F.col("digest")), total, ["best_id", "n"])
    grouped = F.col("n").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("best_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("id").eqNullSafe(F.col("best_id"))).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts (see exact_dedup), all columns as they were.

    A row with a null id can't be named and stays. Of repeated rows of the id that stays, one stays.
    """
    verdicts = exact_dedup(docs, id_col, text_col).where(~F.col("kept") & F.col(id_col).isNotNull())
    gone = verdicts.select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).distinct()
    digest = F.sha2(normalised(F.col(text_col)), 256)
    left = docs.withColumn("__mine", digest)
    left = left.join(gone, (left[id_col] == gone["__id"]) & (left["__mine"] == gone["__digest"]), "left_anti")
    repeated = docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1 and __id is not null").select("__id")
    if repeated.isEmpty():
        return left.drop("__mine")
    once = left.join(repeated, left[id_col] == repeated["__id"], "left_semi").dropDuplicates([id_col, "__mine"])
    others = left.join(repeated, left[id_col] == repeated["__id"], "left_anti")
    return others.unionByName(once).drop("__mine")
