"""A cache of two tiers as keyed state: what is set, got and deleted comes as rows, and each get tells what it found.

ops(op: set, get, delete; key; at, in milliseconds; seq, which orders them; ttl, in milliseconds, null for the default
and 0 or less for no end; priority; tier). A set writes to memory if that is its tier or its priority is high, and to the
persistent tier if that is its tier or its priority is normal at least. A get asks memory first. An entry that has
expired still serves, stale, for a while; beyond that it goes, and the next tier is asked. What the persistent tier answers is
promoted: it is in memory from then on, with the end it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltworks.operators.cache import NORMAL, STALE_SECONDS
from siltworks.session import ship
from siltworks.streaming.stateful import as_rows, need_rocksdb, over_table

# How long an entry lives by default, and the first of the high priorities.
DEFAULT_TTL, HIGH = 30 * 60 * 1000, 3
TIERS = ("memory", "persistent")
FOUND = "key string, seq long, at long, tier string, result string, promoted boolean"
_NO_END = -1
_WHOLE = ("seq", "at", "ttl", "priority")


class Tiers:
    """The end of a key's entry in each tier: None without one, ``_NO_END`` if it does not expire."""

    def __init__(self, stale: int = STALE_SECONDS * 1000):
        self.stale, self.ends = stale, {}

    def _asked(self, tier: str, at: int) -> str | None:
        end = self.ends.get(tier)
        if end is None:
            return None
        if end == _NO_END or at <= end:
            return "hit"
        if at - end <= self.stale:
            return "stale"
        del self.ends[tier]
        return None

    def __call__(self, row: dict) -> list[dict]:
        op, at = row["op"], row["at"]
        if op == "set":
            ttl = DEFAULT_TTL if row["ttl"] is None else row["ttl"]
            end = at + ttl if ttl > 0 else _NO_END
            tier, priority = row["tier"] or "memory", NORMAL if row["priority"] is None else row["priority"]
            if tier == "memory" or priority >= HIGH:
                self.ends["memory"] = end
            if tier == "persistent" or priority >= NORMAL:
                self.ends["persistent"] = end
        elif op == "delete":
            self.ends.clear()
        elif op == "get":
            for tier in TIERS:
                if (result := self._asked(tier, at)) is not None:
                    if tier == "persistent":
                        self.ends["memory"] = self.ends[tier]
                    return [{"key": row["key"], "seq": row["seq"], "at": at, "tier": tier, "result": result, "promoted": tier == "persistent"}]
            return [{"key": row["key"], "seq": row["seq"], "at": at, "tier": None, "result": "miss", "promoted": False}]
        return []

    def last(self) -> int | None:
        """When the last entry is of no use any more; None while there is one without an end."""
        ends = list(self.ends.values())
        return None if _NO_END in ends or not ends else max(ends) + self.stale


def _columns(ops: DataFrame) -> DataFrame:
    return ops.select(F.col("key").cast("string"), F.col("seq").cast("long"), "op", F.col("at").cast("long"), F.col("ttl").cast("long"), F.col("priority").cast("long"), "tier")


def replay(ops: DataFrame, stale: int = STALE_SECONDS * 1000) -> DataFrame:
    """key, seq, at, tier, result (hit, stale, miss), promoted: one row a get of a table of operations."""
    return over_table(_columns(ops), "key", ["seq"], lambda: Tiers(stale), FOUND)


class _Cache(StatefulProcessor):
    """State: the two ends. A timer takes them away once neither tier can answer any more."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "memory long, persistent long")

    def _loaded(self) -> Tiers:
        out = Tiers(self.stale)
        if self.ends.exists():
            out.ends = {t: int(e) for t, e in zip(TIERS, self.ends.get()) if e is not None}
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tiers = self._loaded()
        out = [x for row in sorted((r for pdf in rows for r in as_rows(pdf, _WHOLE)), key=lambda r: r["seq"]) for x in tiers(row)]
        if tiers.ends:
            self.ends.update(tuple(tiers.ends.get(t) for t in TIERS))
            if (last := tiers.last()) is not None:
                self.handle.registerTimer(last + 1)
        else:
            self.ends.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self._loaded().last()
        if last is not None and last < timerValues.getCurrentWatermarkInMs():
            self.ends.clear()
        return iter([])

    def close(self) -> None:
        pass


def replay_stream(ops: DataFrame, late: str = "0 seconds", stale: int = STALE_SECONDS * 1000) -> DataFrame:
    """The same for a stream whose operations come in order, up to ``late``; those of a micro-batch are ordered by ``seq``."""
    need_rocksdb(ops.sparkSession)
    ship(ops.sparkSession)
    rows = ops.withColumn("_time", F.timestamp_millis(F.col("at").cast("long"))).withWatermark("_time", late)
    return _columns(rows).groupBy("key").transformWithStateInPandas(_Cache(stale), FOUND, "append", "eventtime")
