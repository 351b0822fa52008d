"""Ordered passes over groups of which one may hold a large part of all rows.

A group that holds more than its share is cut into time slices. Each slice is its own window
partition, and what a slice needs to know of the earlier ones arrives as a small broadcast table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.times import micros
from gavelspark.session import shared_dir


@dataclass(frozen=True)
class Split:
    """A group is cut when it has more than `min_rows` rows and more than 1/`share` of all rows.

    At most `share` groups can satisfy the second condition, and their slices sum to at most
    `fan * share` (+1 each): the tables broadcast below have that many rows at most, whatever
    the size of the log.
    """

    min_rows: int = 1_000_000
    share: int = 5_000
    fan: int = 4


DEFAULT = Split()


def oversized(log: DataFrame, key: str, at: str, split: Split = DEFAULT) -> DataFrame | None:
    """(key, first, span, slices) of the groups to cut, None when there are none.

    Runs now, as later plans depend on it: a count per key, and the time span of what is too large.
    The bounded result is kept in the shared folder, so no later plan repeats these passes.
    """
    shared_dir(log.sparkSession)
    sizes = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    fair = F.greatest(F.lit(split.min_rows), F.ceil(sizes.agg(F.sum("n")).scalar() / split.share))
    large = sizes.where(F.col("n") > split.min_rows).withColumn("fair", fair).where("n > fair").checkpoint()
    if large.isEmpty():
        return None
    first, last = F.min(at), F.max(at)
    return (
        log.join(F.broadcast(large), key)
        .groupBy(key)
        .agg(
            first.alias("first"),
            (micros(last) - micros(first) + 1).alias("span"),
            F.ceil(split.fan * F.first("n") / F.first("fair")).cast("int").alias("slices"),
        )
        .checkpoint()
    )


def _slice(at: Column) -> Column:
    # Both factors are fixed within a group, so the slice number never decreases with time.
    share = (micros(at) - micros(F.col("first"))) / F.col("span")
    return F.coalesce(F.least(F.floor(share * F.col("slices")).cast("int"), F.col("slices") - 1), F.lit(0))


def cut(log: DataFrame, hot: DataFrame | None, key: str, at: str, row: str = "id") -> DataFrame:
    """The log with its `slice`; groups that are not cut are all slice 0.

    Rows without a key are no group: they get slices of their own, to spread them.
    """
    apart = F.pmod(F.hash(row), F.lit(1024))
    if hot is None:
        return log.withColumn("slice", F.when(F.col(key).isNull(), apart).otherwise(0))
    number = F.when(F.col(key).isNull(), apart).otherwise(_slice(F.col(at)))
    sliced = log.join(F.broadcast(hot), key, "left").withColumn("slice", number).drop("first", "span", "slices")
    # Said outright, as a log that comes distributed by its key alone would satisfy what follows.
    return sliced.repartition(key, "slice")


def only_oversized(log: DataFrame, hot: DataFrame, key: str, at: str) -> DataFrame:
    """The rows of the cut groups, with their `slice`."""
    return log.join(F.broadcast(hot), key).withColumn("slice", _slice(F.col(at))).drop("first", "span", "slices")


def spread(parents: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """One copy of a parent row per slice of its group, so that children join on (key, slice)."""
    if hot is None:
        return parents.withColumn("slice", F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)
    return (
        parents.join(F.broadcast(hot.select(key, "slices")), key, "left")
        .withColumn("slice", F.explode(copies))
        .drop("slices")
    )


def earlier_slices(per_slice: DataFrame, key: str, value: str) -> DataFrame:
    """Per (key, slice), the maximum of `value` over the slices before it. One row per slice in."""
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.withColumn(value, F.max(value).over(before))
