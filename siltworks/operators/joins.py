"""Joins beyond equality: as-of, interval overlap, difference, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the last right ``value`` of its key at or before it.

    One union and one window: a single exchange on the key, no range join.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("asof_value", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_v")


def overlapping(left: DataFrame, right: DataFrame, key: str, margin: int = 0) -> DataFrame:
    """Left intervals (start, end) that overlap any right one of their key, widened by the margin."""
    r = right.select(F.col(key).alias("_k"), (F.col("start") - margin).alias("_s"), (F.col("end") + margin).alias("_e"))
    return left.join(r, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("end")) & (F.col("_e") >= F.col("start")), "left_semi")


def resolved(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the previous set that are not in the current one, compared whole; null equals null."""
    names = previous.columns
    now = current.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(names)))
    return previous.join(now, same, "left_anti")


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (added, removed, modified), old, new."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(True).alias("_a")), after.select(key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, key, "full").withColumn("status", status).filter(F.col("status").isNotNull()).select(key, "status", "old", "new")


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by ``seq``, changes included."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return base.unionByName(changes).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
