"""Caches as tables: entries(key, size, created_at, accessed_at, expires_at, access_count, priority, tags, tier, seq).

Times are timestamps; ``now`` is a column or a literal, so a result does not depend on a clock. ``by`` names the
columns that tell caches apart: eviction is ordered within each, so many caches are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in bytes, how long a stale entry still serves, priorities, and what compression must save.
MEMORY_SIZE, PERSISTENT_SIZE = 100 * 1024 * 1024, 500 * 1024 * 1024
STALE_SECONDS = 300
NORMAL = 2
COMPRESS_FROM, COMPRESS_TO = 10 * 1024, 0.9
OVERHEAD = 32


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def age_seconds(since: Column, now: Column) -> Column:
    return (_us(now) - _us(since)) / 1_000_000


def eviction_score(policy: str, now: Column, max_size: int = MEMORY_SIZE) -> Column:
    """The value by which entries go, the lowest first."""
    if policy == "lru":
        return _us(F.col("accessed_at")).cast("double")
    if policy == "lfu":
        return F.col("access_count").cast("double")
    idle = age_seconds(F.col("accessed_at"), now)
    if policy == "arc":
        # as it is known: the most recently used goes first
        return idle * 0.5 + 1 / (F.col("access_count") + 1) * 1000 * 0.5
    if policy == "smart":
        overdue = F.when(F.col("expires_at").isNotNull(), F.greatest(F.lit(0.0), age_seconds(F.col("expires_at"), now) / 60)).otherwise(0.0)
        score = 0.1 * age_seconds(F.col("created_at"), now) / 3600 + 0.3 * idle / 60 + 0.2 / F.log(F.col("access_count") + 2) + 0.2 / F.col("priority") + 0.1 * F.col("size") / max_size * 10 + 0.1 * overdue
        return -score
    raise ValueError(f"Unknown eviction policy: {policy}")


def eviction_order(entries: DataFrame, policy: str, now: Column, by: Sequence[str] = (), max_size: int = MEMORY_SIZE) -> DataFrame:
    """Adds ``score`` and ``victim``, the place of each entry in the order of eviction; under arc, entries of more than
    normal priority never go and are left out. Ties go by ``seq``."""
    rows = entries.filter(F.col("priority") <= NORMAL) if policy == "arc" else entries
    rows = rows.withColumn("score", eviction_score(policy, now, max_size))
    return rows.withColumn("victim", F.row_number().over(Window.partitionBy(*by).orderBy("score", "seq")))


def evicted(entries: DataFrame, policy: str, now: Column, room: Column | int, by: Sequence[str] = (), max_size: int = MEMORY_SIZE) -> DataFrame:
    """The entries that go so that each cache has at most ``max_size - room`` bytes: victims in their order until
    enough is freed."""
    total = Window.partitionBy(*by)
    sized = entries.withColumn("_over", F.sum("size").over(total) + (F.lit(room) if isinstance(room, int) else room) - max_size)
    order = Window.partitionBy(*by).orderBy("victim").rowsBetween(Window.unboundedPreceding, -1)
    rows = eviction_order(sized, policy, now, by, max_size).withColumn("_freed", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return rows.filter(F.col("_freed") < F.col("_over")).drop("_over", "_freed")


def over_count(entries: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """What remains of caches of at most so many entries: the last used."""
    w = Window.partitionBy(*by).orderBy(F.desc("accessed_at"), F.desc("seq"))
    return entries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def status(expires_at: Column, now: Column, stale_seconds: int = STALE_SECONDS) -> Column:
    """fresh, stale (expired, but it still serves) or expired; without an end an entry is fresh."""
    late = age_seconds(expires_at, now)
    return F.when(expires_at.isNull() | (late <= 0), "fresh").when(late <= stale_seconds, "stale").otherwise("expired")


def live(entries: DataFrame, now: Column) -> DataFrame:
    """What is saved and restored: entries that have not expired."""
    return entries.filter(F.col("expires_at").isNull() | (_us(F.col("expires_at")) >= _us(now)))


def lookups(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked(ask, key, at) with ``tier`` and ``result``: hit, stale, or miss; memory is asked before the persistent tier.

    A hit on the persistent tier is ``promoted``. Each lookup counts once.
    """
    e = entries.select(F.col("key").alias("_k"), F.col("tier").alias("_tier"), F.col("expires_at").alias("_end"))
    found = asked.join(e, F.col("key") == F.col("_k"), "left").withColumn("_s", F.when(F.col("_k").isNotNull(), status(F.col("_end"), F.col("at"))))
    usable = F.col("_s").isin("fresh", "stale")
    best = F.min(F.when(usable, F.struct(F.when(F.col("_tier") == "memory", 0).otherwise(1).alias("o"), F.col("_tier").alias("tier"), F.col("_s").alias("s"))))
    each = found.groupBy("ask", "key", "at").agg(best.alias("b"))
    result = F.when(F.col("b").isNull(), "miss").when(F.col("b.s") == "fresh", "hit").otherwise("stale")
    return each.select("ask", "key", "at", F.col("b.tier").alias("tier"), result.alias("result"), F.coalesce(F.col("b.tier") == "persistent", F.lit(False)).alias("promoted"))


def promoted(entries: DataFrame, looked: DataFrame) -> DataFrame:
    """The entries after the lookups: those found in the persistent tier are in memory as well."""
    keys = looked.filter("promoted").select("key").distinct()
    copies = entries.filter("tier = 'persistent'").join(keys, "key", "left_semi").withColumn("tier", F.lit("memory"))
    return entries.join(copies.select("key", "tier"), ["key", "tier"], "left_anti").unionByName(copies)


def tier_of(priority: Column) -> Column:
    """Where an entry is kept: high priorities in memory, normal in both tiers' first, low in the persistent one."""
    return F.when(priority >= NORMAL, "memory").otherwise("persistent")


def hit_rates(looked: DataFrame, *by: str) -> DataFrame:
    """hits, misses and the rate, 0 where nothing was asked; a stale answer is a hit."""
    hits = F.count_if(F.col("result") != "miss")
    return looked.groupBy(*by).agg(hits.alias("hits"), F.count_if(F.col("result") == "miss").alias("misses"), F.round(F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)), 6).alias("hit_rate"))


def utilization(entries: DataFrame, *by: str, max_size: int = MEMORY_SIZE + PERSISTENT_SIZE) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), F.sum("size").alias("size"), F.round(F.sum("size") / max_size, 9).alias("utilization"))


def invalidated(entries: DataFrame, tag: str) -> DataFrame:
    """What remains when a tag is invalid: entries in memory with that tag go, those of the persistent tier stay."""
    return entries.filter(~(F.coalesce(F.array_contains("tags", tag), F.lit(False)) & (F.col("tier") == "memory")))


def size_estimate(key: Column, value_json: Column) -> Column:
    """Bytes of an entry, to be summed."""
    return 2 * F.length(key) + 2 * F.length(value_json) + OVERHEAD


def stored_size(size: Column, compressed: Column) -> Column:
    """Large values are kept compressed if that saves more than a tenth."""
    return F.when((size > COMPRESS_FROM) & (compressed < size * COMPRESS_TO), compressed).otherwise(size)


def request_key(prefix: str, *parts: Column) -> Column:
    """A key made of a hash of the request as JSON; parts that are null are left out of it."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16))
