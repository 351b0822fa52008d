"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (columns a, b; a stored table); the label is the smallest node of the component.

    Each step moves every node to the smallest one of its neighbourhood and keeps the links between what is left. A star around its
    smallest node is done in one step, a chain halves at least. Only links travel, combined before each shuffle.
    """
    links = links.where("a != b")
    labels = None
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", F.col("b").alias("c")), F.struct(F.col("b").alias("a"), F.col("a").alias("c")))).alias("x"))
        moved = written(both.groupBy(F.col("x.a").alias("node")).agg(F.least(F.min("x.c"), F.first("x.a")).alias("to")))
        to = lambda column: moved.select(F.col("node").alias(column), F.col("to").alias(f"to_{column}"))
        links = written(
            links.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if labels is None:
            labels = moved.withColumnRenamed("to", "label")
        else:
            step = moved.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links, which are contracted by the labels so far."""
    to = lambda column: labels.select(F.col("node").alias(column), F.col("label").alias(f"to_{column}"))
    ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    step = components(written(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    new = step.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return written(moved.select("node", F.coalesce("to", "label").alias("label")).union(new))
