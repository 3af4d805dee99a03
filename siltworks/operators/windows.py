"""Window-like operators over keyed, timed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, n: int, keys: list[str], order: list) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sliding_rate(df: DataFrame, key: str, ts: str, seconds: int, stretch: int = 24) -> DataFrame:
    """Rows of the key in the window that ends at each row, by the window's seconds.

    Time is cut into stretches of so many windows, so that a key is not one task; the rows of the last window of a
    stretch go to the next one as well, to be counted there.
    """
    span = 1000 * seconds * stretch
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    at = F.floor(F.col("_ms") / span)
    rows = df.withColumn("_ms", ms).withColumn("_at", at)
    carried = F.when(F.col("_ms") >= (F.col("_at") + 1) * span - 1000 * seconds, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at"))
    rows = rows.withColumn("_own", F.col("_at")).withColumn("_at", F.explode(carried))
    w = Window.partitionBy(key, "_at").orderBy("_ms").rangeBetween(-1000 * seconds, 0)
    return rows.withColumn("rate", F.round(F.count("*").over(w) / seconds, 9)).filter("_own = _at").drop("_ms", "_at", "_own")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands: session number of each row within its key."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    new = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def debounce(df: DataFrame, key: str, ts: str, wait_seconds: int) -> DataFrame:
    """Trailing debounce: rows that no other of their key follows within the wait."""
    w = Window.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_next", F.lead(us).over(w)).filter(F.col("_next").isNull() | (F.col("_next") - us >= wait_seconds * 1_000_000)).drop("_next")


def debounce_leading(df: DataFrame, key: str, ts: str, wait_seconds: int) -> DataFrame:
    """Leading debounce: the first row of each burst; a burst ends where the wait passes without a row of its key."""
    return sessions(df, key, ts, wait_seconds).withColumn("_n", F.row_number().over(Window.partitionBy(key, "session").orderBy(ts))).filter("_n = 1").drop("_n")


def running_mean(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mean", F.round(F.avg(value).over(w) + 1e-9, 6))


def soft_limit(counts: DataFrame, keys: list[str], order: list[str], n: str, limit: int) -> DataFrame:
    """Groups up to and including the one that reaches the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(n).over(w), F.lit(0))).filter(F.col("_before") < limit).drop("_before")


def top_with_rest(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, each with how many more there are."""
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("_n", F.row_number().over(w.orderBy(*order)))
        .withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - k).cast("long"))
        .filter(F.col("_n") <= k)
        .drop("_n")
    )
