"""The corpus pipeline: quality filter, exact dedup, near-duplicate removal, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.classifier import FtrlConfig, keep_scored, train, training_rows
from codelake.llm.common import stage_table
from codelake.llm.exact_dedup import exact_dedup
from codelake.llm.packing import pack_documents
from codelake.llm.queries import END_ID, GOOD, fold
from codelake.llm.shingle_join import shingle_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier scores below GOOD. It learns from the labels of the folds that op4 learns from.

    Rows are kept or dropped by their own text, so rows with a null id and repeated rows are judged like any other.
    """
    config = FtrlConfig()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(training_rows(docs, labels, lambda i: fold(i, 4) != 2, config), config)
    return keep_scored(docs, weights, GOOD, config)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with __row, a number of its own for each row, and __key, which sorts as the id does, null last, and tells rows of one id apart.

    The table is written, so that the numbers stay as they are.
    """
    rows = stage_table(docs.withColumn("__row", F.monotonically_increasing_id()), name)
    return rows.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("__row").alias("row")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of equal texts, also where ids are null or repeated."""
    rows = keyed(docs, "exact-rows")
    gone = exact_dedup(rows, "__key").where("not kept").select(F.col("__key.row").alias("row"))
    return rows.join(gone, rows["__row"] == gone["row"], "left_anti").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group that links of 0.8 similarity on five-word shingles make: the one with the smallest id, null last.

    Rows without words link with nothing and stay. Rows are told apart by their number, so a null or repeated id is like any other.
    """
    rows = keyed(docs, "near-rows")
    linked = stage_table(shingle_components(rows, id_col="__row").select("__row", "component_id"), "near-components")
    groups = linked.groupBy("component_id").count().where("count > 1").select("component_id")
    members = linked.join(groups, "component_id").join(rows.select("__row", "__key"), "__row")
    best = members.groupBy("component_id").agg(F.min("__key").alias("best"))
    gone = members.join(best, "component_id").where("__key <> best").select(F.col("__row").alias("row"))
    return rows.join(gone, rows["__row"] == gone["row"], "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs, packed into sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: No stage but the exact one can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
