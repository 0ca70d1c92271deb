"""Connected components over an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of edges(a, b) reaches. Each step is a few joins and a written table; steps grow with the
    logarithm of a component's diameter. Self-loops and repeated edges do no harm; null ends are passed over."""
    edges = edges.where("a is not null and b is not null")
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "least").alias("low"))
        jump = lower.select(F.col("node").alias("at"), F.col("low").alias("next"))
        step = lower.join(jump, F.col("low") == F.col("at")).select("node", "comp", F.least("low", "next").alias("new"))
        step = stage_table(step, "labels")
        done = step.where("new <> comp").isEmpty()
        labels = step.select("node", F.col("new").alias("comp"))
        if done:
            return labels
