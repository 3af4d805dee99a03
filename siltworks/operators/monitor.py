"""Performance: timers, distributions, rates, snapshots, alerts at rest, health, progress."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A distribution takes the last so many values.
HISTORY = 1000
WINDOW_SECONDS = 60
# Phases in their order with their weights, and thresholds of alerts (metric, operator, warning, critical).
PHASES = (("initializing", 0.05), ("parsing", 0.15), ("pattern_matching", 0.25), ("data_flow", 0.20), ("taint_analysis", 0.15), ("llm_enhancement", 0.10), ("aggregation", 0.05), ("finalizing", 0.05))
THRESHOLDS = (("analysisTime.average", "gt", 30000, 60000), ("memory.heapUsed", "gt", 500 * 1024 * 1024, 800 * 1024 * 1024), ("errors.rate", "gt", 0.1, 0.25), ("cache.hitRate", "lt", 0.5, 0.3))


def _ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def timers(starts: DataFrame, stops: DataFrame) -> DataFrame:
    """starts(id, name, at) with duration in ms and ``ok`` of stops(id, at, ok); both null while pending."""
    s = stops.select("id", F.col("at").alias("_stop"), "ok")
    return starts.join(s, "id", "left").withColumn("duration", _ms(F.col("_stop")) - _ms(F.col("at"))).drop("_stop")


def operations(timed: DataFrame, *by: str) -> DataFrame:
    """total (ended), successful, failed, pending."""
    ended = F.col("ok").isNotNull()
    return timed.groupBy(*by).agg(F.count_if(ended).alias("total"), F.count_if(F.col("ok")).alias("successful"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~ended).alias("pending"))


#: Ranges of values that a group's ranks are looked for in.
RANGES = 32


def nearest_ranks(rows: DataFrame, value: str, by: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """The columns ``by``, percent and ``at``: the least value of the group that so many percent of its rows do not exceed.

    Exact, in two steps: a sketch of each group's values cuts them into ranges; the ranges' counts tell in which
    range each rank lies, and only those ranges are sorted. So neither a sort nor a buffer ever holds
    all values of a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    same = lambda other: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys), F.lit(True))
    renamed = lambda df, other: df.select(*(F.col(k).alias(f"{other}{k}") for k in keys), *(c for c in df.columns if c not in keys))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"), F.sum("_c").alias("_all"))
    ranged = counts.join(renamed(cuts, "s"), same("s")).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).select(*keys, "_v", "_c", "_r", "_all")
    per_range = ranged.groupBy(*keys, "_r").agg(F.sum("_c").alias("_n"), F.first("_all").alias("_all"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), F.greatest(F.lit(1), F.expr(f"(_all * {p} + 99) div 100")).alias("rank")) for p in percents)))
    wanted = per_range.withColumn("_before", before).withColumn("_p", ranks).filter((F.col("_p.rank") > F.col("_before")) & (F.col("_p.rank") <= F.col("_before") + F.col("_n")))
    wanted = wanted.select(*keys, F.col("_r").alias("_in"), F.col("_p.percent").alias("percent"), (F.col("_p.rank") - F.col("_before")).alias("_rank"))
    some = ranged.join(renamed(wanted, "w"), same("w") & (F.col("_r") == F.col("_in"))).select(*keys, "percent", "_rank", "_v", "_c")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "percent").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = some.withColumn("_upto", upto).filter("_upto >= _rank").groupBy(*keys, "percent").agg(F.min("_v").alias("at"))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), "percent", "at")


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), order: Sequence | None = None, last: int | None = None) -> DataFrame:
    """count, mean, least, most, total, p50, p95, p99 of each group, percentiles by nearest rank; with ``last`` of the last so many by ``order``."""
    rows = df.filter(F.col(value).isNotNull())
    if last is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(o) for o in order or [])))).filter(F.col("_n") <= last)
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sum(value), 4).alias("total"))
    p = lambda q: F.max(F.when(F.col("percent") == q, F.col("at"))).alias(f"p{q}")
    ranks = nearest_ranks(rows, value, by, (50, 95, 99)).groupBy(*by).agg(p(50), p(95), p(99))
    ranks = ranks.select(*(F.col(c).alias(f"_{c}") for c in by), "p50", "p95", "p99")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
    return whole.join(ranks, same, "left").drop(*(f"_{c}" for c in by))


def analysis_times(timed: DataFrame) -> DataFrame:
    """Durations of the timers that measure an analysis."""
    return timed.filter(F.contains("name", F.lit("analysis")) & F.col("duration").isNotNull())


def counter_rate(counts: DataFrame, now: Column, n: str = "n", at: str = "at", by: Sequence[str] = (), seconds: int = WINDOW_SECONDS) -> DataFrame:
    """What counters(at, n) recorded in the window before ``now``, and by second."""
    here = (_ms(F.col(at)) >= _ms(now) - 1000 * seconds) & (_ms(F.col(at)) <= _ms(now))
    total = F.coalesce(F.sum(F.when(here, F.col(n))), F.lit(0))
    return counts.groupBy(*by).agg(total.alias("count"), F.round(total / seconds, 9).alias("rate"))


def error_rate(timed: DataFrame, now: Column, by: Sequence[str] = (), seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Failures in the window before ``now`` as a share of all that ever ended; 0 where nothing has."""
    recent = F.count_if(~F.col("ok") & (_ms(F.col("ended")) >= _ms(now) - 1000 * seconds) & (_ms(F.col("ended")) <= _ms(now)))
    total = F.count_if(F.col("ok").isNotNull() & (_ms(F.col("ended")) <= _ms(now)))
    return timed.groupBy(*by).agg(recent.alias("errors"), total.alias("total"), F.round(F.coalesce(F.try_divide(recent, total), F.lit(0.0)), 9).alias("rate"))


def snapshot(distributions: DataFrame, rates: DataFrame, errors: DataFrame, cache: DataFrame, at: Column) -> DataFrame:
    """One row: the parts, each of one row, as nested structs; a metric's path is then a column's path."""
    nested = lambda df, name: df.select(F.struct("*").alias(name))
    out = nested(distributions, "analysisTime").join(nested(rates, "throughput")).join(nested(errors, "errors")).join(nested(cache, "cache"))  # each side has one row
    return out.select(at.alias("at"), F.struct("analysisTime", "throughput", "errors", "cache").alias("metrics"))


def unresolved(alerts: DataFrame) -> DataFrame:
    """alerts(metric, at, level, ...): the last alert of each metric, where no resolution follows it."""
    w = Window.partitionBy("metric").orderBy(F.desc("at"))
    return alerts.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and level != 'resolved'").drop("_n")


def health(components: DataFrame, *by: str) -> DataFrame:
    """components(status) rolled up: unhealthy before degraded before healthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    return components.groupBy(*by).agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.max(rank) + 1).alias("status"))


def component_status(workers: Column, hit_rate: Column, alerts: Column, critical: Column) -> Column:
    """The status of the three components by their figures; array<struct<name, status>>."""
    part = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    return F.array(
        part("workerPool", F.when(workers > 0, "healthy").otherwise("degraded")),
        part("cache", F.when(hit_rate > 0.5, "healthy").otherwise("degraded")),
        part("monitor", F.when(alerts == 0, "healthy").when(critical > 0, "unhealthy").otherwise("degraded")),
    )


def batch_outcome(tasks: DataFrame, *by: str) -> DataFrame:
    """tasks(error): ok, or the error of a batch with how many of its tasks failed."""
    failed, total = F.count("error"), F.count("*")
    message = F.concat(F.lit("Batch failed: "), failed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" tasks failed"))
    return tasks.groupBy(*by).agg((failed == 0).alias("ok"), F.when(failed > 0, message).alias("message"))


def queue_status(requests: DataFrame, *by: str) -> DataFrame:
    return requests.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "active", "completed", "failed")))


def progress(phase: Column, done: Column, total: Column) -> Column:
    """Percent: the weights of the phases before, and of the current one the share of files done; at most 99."""
    before, weight, sum_ = F, F, 0.0
    for name, w in PHASES:
        before, weight, sum_ = before.when(phase == name, sum_ * 100), weight.when(phase == name, w), sum_ + w
    share = F.when(total > 0, done / total).otherwise(0.0)
    return F.least(F.lit(99.0), before + weight * share * 100)


def remaining_ms(elapsed: Column, percent: Column) -> Column:
    """What is left at the pace so far; null before there is any progress."""
    return F.when(percent > 0, F.greatest(F.lit(0.0), elapsed / percent * 100 - elapsed))


def numbered(messages: DataFrame, order: Sequence[str], by: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Adds ``sequence`` from 1 and, with a size, ``batch`` from 0."""
    out = messages.withColumn("sequence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if size is None else out.withColumn("batch", F.floor((F.col("sequence") - 1) / size).cast("long"))


def timed_batches(events: DataFrame, ts: str, by: Sequence[str], size: int, seconds: int) -> DataFrame:
    """Adds ``batch``: a batch ends when it has ``size`` rows or its first row is ``seconds`` old.

    Windows of ``seconds`` from each key's first row bound the time, and rows are counted within them.
    """
    first = F.min(_ms(F.col(ts))).over(Window.partitionBy(*by))
    slot = F.floor((_ms(F.col(ts)) - first) / (1000 * seconds)).cast("long")
    rows = events.withColumn("slot", slot)
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by, "slot").orderBy(ts)) - 1) / size).cast("long"))


def throughput(snapshots: DataFrame, by: Sequence[str], at: str, completed: str) -> DataFrame:
    """Adds ``per_second``: what was completed since the row before, by the time since; null for the first."""
    w = Window.partitionBy(*by).orderBy(at)
    dt = (_ms(F.col(at)) - F.lag(_ms(F.col(at))).over(w)) / 1000
    return snapshots.withColumn("per_second", F.round(F.try_divide(F.col(completed) - F.lag(completed).over(w), dt), 9))


def logged(entries: DataFrame, least: int) -> DataFrame:
    """Log entries of a level or more."""
    return entries.filter(F.col("level") >= least)
