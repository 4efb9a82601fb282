"""Numbers and running totals over sorted tables of which no group has to fit into one task.

A table is sorted over range partitions, which may cut through a group, and written; each row then knows its place
within its partition, and the partitions' sizes, one row each, give what comes before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.shared import cut, if_small

_LOW = (1 << 33) - 1


def placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` sorted and written, with ``__pid`` and ``__at``: partition, and place within it from 0."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    written = cut(ranged, "ordered")
    return written.withColumn("__pid", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit(_LOW))).drop("__id")


def _before(per: DataFrame, value: str) -> DataFrame:
    """``__pid, __before``: the total of the partitions before; a row a partition."""
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select("__pid", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("__before")))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``name``: 0, 1, 2, … in the order of ``order``. Rows that are equal in it are numbered in any order."""
    sorted_ = placed(df, order)
    before = _before(sorted_.groupBy("__pid").agg(F.count("*").alias("n")), "n")
    return sorted_.join(before, "__pid").withColumn(name, F.col("__before") + F.col("__at")).drop("__pid", "__at", "__before")


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``name``: 1, 2, 3, … within each group; a group may lie across many tasks."""
    all_ = numbered(df, [*keys, *order], "__no")
    first = all_.groupBy(*keys).agg(F.min("__no").alias("__first"))
    return all_.join(if_small(cut(first, "ordered-first")), [*keys]).withColumn(name, (F.col("__no") - F.col("__first") + 1).cast("long")).drop("__no", "__first")


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``name``: the total of ``value`` over all rows before, 0 for the first."""
    sorted_ = placed(df, order)
    before = _before(sorted_.groupBy("__pid").agg(F.sum(value).alias("n")), "n")
    w = Window.partitionBy("__pid").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = sorted_.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(before, "__pid").withColumn(name, F.col("__before") + F.col("__in")).drop("__pid", "__at", "__before", "__in")
