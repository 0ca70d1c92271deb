"""How document filters act on one another: every order of them is replayed over every document, relationally.

Each document's flags meet a broadcast table of the orders, each pair is exploded into its steps, the first step that the document fails is
found, and conditional counts are taken by part, order and step. Spark combines them before the shuffle, so what moves is at most one row a
task for each part, order and step, however large a part is.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stage_table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"

#: More filters than this have too many orders to replay.
MOST_FILTERS = 6

#: Fewer words, a lower share of distinct words, a higher share of capitals (both in hundredths), and any of the marks fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text (null: empty) fails A (few words), B (few distinct ones), C (capitals) and D (marks)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.char_length(text).cast("long") * MOST_CAPITALS,
        "D": text.rlike(MARKS),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part string, failed int, good boolean, toxic boolean): a row a document; bit i of failed is set if it fails filter FILTERS[i].

    Null text is empty, a null part the empty string. E fails where another row of the same text has a smaller id; a null id is neither smaller
    nor larger than another, so such rows never fail E. good and toxic tell that any row of labels with the id says so; rows without a label, or
    with a null id, are neither. Repeated rows are documents of their own. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(text).items()), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("failed"), F.sha2(text, 256).alias("digest"))
    rows = stage_table(rows, "flags")  # the texts are read once

    copies = rows.groupBy(F.col("digest").alias("group")).agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    copies = stage_table(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    rows = join_groups(rows, copies, F.col("digest"), total, ["least"])
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = rows.select("id", "part", (F.col("failed") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))

    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("__doc"))
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("id is not null").join(marked, F.col("id") == F.col("__doc"), "left")
    known = known.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return known.unionByName(rows.where("id is null").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def replay_orders(flags: DataFrame, filters: str = FILTERS, lost: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """(part, filter_order, step int, kept, removed, redundant, unique_fails, <mark>_lost for each of lost, shapley; all long): what each filter
    does at each step of every order of the filters, in each part.

    flags has part, failed (bit i: fails filters[i]) and a boolean column for each of lost. The first filter of an order that a document fails
    removes it: kept counts those that no filter up to this step removed, removed those it removes, redundant those that fail it but are gone,
    unique_fails those that fail it alone, and shapley a filter's removed over all orders. Each part has a row for each order and step; without
    documents there is none.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters can be replayed")
    count, spark = len(filters), flags.sparkSession
    places = [f"bit{k}" for k in range(1, count + 1)]
    orders = [("".join(order), *(1 << filters.index(f) for f in order)) for order in permutations(filters)]
    orders = spark.createDataFrame(orders, "filter_order string, " + ", ".join(f"{p} int" for p in places))

    crossed = flags.crossJoin(F.broadcast(orders))
    first = F.lit(count + 1)
    for k in range(count, 0, -1):
        first = F.when(F.col("failed").bitwiseAND(F.col(places[k - 1])) != 0, k).otherwise(first)
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(places[k - 1]).alias("bit")) for k in range(1, count + 1))))
    stepped = crossed.select("part", "failed", *lost, "filter_order", first.alias("first"), steps.alias("at"))
    stepped = stepped.select("part", "failed", *lost, "filter_order", "first", F.col("at.step").alias("step"), F.col("at.bit").alias("bit"))

    removes = F.col("first") == F.col("step")
    counted = stepped.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removes).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("failed").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        F.count_if(F.col("failed") == F.col("bit")).alias("unique_fails"),
        *(F.count_if(removes & F.col(mark)).alias(f"{mark}_lost") for mark in lost),
    )
    counted = stage_table(counted, "steps")
    letter = F.expr("substring(filter_order, step, 1)")
    shares = counted.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    shares = shares.select(F.col("part").alias("__part"), "letter", "shapley")
    return counted.join(shares, (counted["part"] == shares["__part"]) & (letter == shares["letter"])).drop("__part", "letter")
