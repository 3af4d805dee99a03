"""Trailing debounce on a stream: of a burst of rows of a key only the last comes out, once the wait has passed.

Equal to ``operators.windows.debounce`` on the same rows, however they are spread over micro-batches: a row is decided when the
watermark has passed its time by the wait, as no row that could follow it in time can come any more. Rows that the
watermark has passed when they come are late, and dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltworks.session import ship
from siltworks.streaming.stateful import micros, need_rocksdb

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _Debounce(StatefulProcessor):
    """State: the rows that are not decided yet, one for each wait at most, and those that have been followed but are still
    ahead of the watermark."""

    def __init__(self, wait_us: int):
        self.wait = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "us long, seq long, row string")

    def _settle(self, rows: list[tuple], mark_us: int) -> Iterator[pd.DataFrame]:
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        follows = [after is not None and after[0] - r[0] < self.wait for r, after in zip(rows, [*rows[1:], None])]
        done = [r for r, f in zip(rows, follows) if not f and r[0] + self.wait <= mark_us]
        # a row that is followed is only kept while one before it may still come, which it would follow
        left = [r for r, f in zip(rows, follows) if (r[0] > mark_us if f else r[0] + self.wait > mark_us)]
        if left:
            self.open.put(left)
            for r, f in zip(rows, follows):
                if not f and r[0] + self.wait > mark_us:
                    self.handle.registerTimer(-(-(r[0] + self.wait) // 1000))
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame({"row": [r[2] for r in done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), None if pd.isna(s) else int(s), r) for pdf in rows for u, s, r in zip(pdf["us"], pdf["seq"], pdf["row"])]
        yield from self._settle(list(self.open.get()) + new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(list(self.open.get()), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def debounce(stream: DataFrame, key: str, ts: str, wait_seconds: int, late: str = "0 seconds", seq: str | None = None) -> DataFrame:
    """The rows of a stream that no other of their key follows within the wait. ``late`` is how much later than its time a row
    may come; of rows of one time the one of the last ``seq`` is the last. Rows without a time are dropped, as they are never last."""
    need_rocksdb(stream.sparkSession)
    ship(stream.sparkSession)
    row = F.to_json(F.struct(*stream.columns), {**_JSON, "ignoreNullFields": "false"})
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), micros(ts).alias("us"), (F.col(seq) if seq else F.lit(None)).cast("long").alias("seq"), row.alias("row"))
    out = rows.groupBy("key").transformWithStateInPandas(_Debounce(wait_seconds * 1_000_000), "row string", "append", "eventtime")
    return out.select(F.from_json("row", stream.schema, _JSON).alias("r")).select("r.*")
