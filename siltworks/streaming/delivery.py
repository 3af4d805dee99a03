"""Delivery of streams: by priority, to several sinks, as lines, and what is told of their progress."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Rows of a delivered batch.
BATCH = 10


def prioritized(rows: DataFrame, rank: Column, order: Iterable[str], size: int = BATCH, by: Iterable[str] = ()) -> DataFrame:
    """Adds ``delivery``: the batch in which a row goes out, the most urgent first, in their order within a rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(rank, *order))
    return rows.withColumn("delivery", F.floor((place - 1) / size).cast("long"))


def prioritized_batches(stream: DataFrame, rank: Column, sink: Callable[[DataFrame, int], None], trigger: str = "100 milliseconds"):
    """Micro-batches handed to ``sink(df, batch_id)`` in order of rank; what is left goes out when the stream ends."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(df.orderBy(rank), i)).trigger(processingTime=trigger)


@dataclass
class FanOut:
    """Hands each micro-batch to all sinks; one that fails does not keep the others from it. Errors are kept."""

    sinks: dict[str, Callable[[DataFrame, int], None]]
    errors: list[tuple[str, int, str]] = field(default_factory=list)

    def __call__(self, df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            for name, sink in self.sinks.items():
                try:
                    sink(held, batch)
                except Exception as e:  # a subscriber's own failure
                    self.errors.append((name, batch, str(e)))
        finally:
            held.unpersist()


def lines(df: DataFrame, kind: str) -> DataFrame:
    """Each row as a line of JSON with its kind."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("payload"))).alias("value"))


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each micro-batch to files; a batch that comes again replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class Messages(StreamingQueryListener):
    """Collects what happens to queries as messages: started, progress, completed or error, each with a number."""

    def __init__(self):
        self.messages: list[dict] = []

    def _say(self, kind: str, **payload) -> None:
        self.messages.append({"type": kind, "sequence": len(self.messages) + 1, **payload})

    def onQueryStarted(self, event) -> None:
        self._say("started", name=event.name)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self._say("progress", batch=p["batchId"], rows=p["numInputRows"], rate=p.get("processedRowsPerSecond"))

    def onQueryIdle(self, event) -> None:
        self._say("heartbeat")

    def onQueryTerminated(self, event) -> None:
        self._say("error" if event.exception else "completed")
