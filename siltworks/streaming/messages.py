"""What streams say of themselves, as a log that survives a restart: every message has a number, and none has it twice.

Kinds: started, progress, issue, batch, metrics, completed, error, cancelled. The log is a folder of Parquet files, a part for
each micro-batch and each message about a query. A part gets its numbers from a head that is written with it; when a
micro-batch comes again after a restart, its part keeps the numbers it had, so nothing is told twice. One log has
one writer at a time.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "sequence long, kind string, query string, payload string"
KINDS = ("started", "progress", "issue", "batch", "metrics", "completed", "error", "cancelled")


class MessageLog:
    """Appends messages to a folder and reads them back."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, threading.Lock()
        self.cancelled: set[str] = set()
        self.last = self._last()

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _last(self) -> int:
        return (self.read().agg(F.max("sequence")).first()[0] or 0) if self._exists(self.path) else 0

    def read(self) -> DataFrame:
        """sequence, kind, query, payload (JSON) of all messages."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def say(self, kind: str, query: str, **payload) -> None:
        """One message about a query."""
        with self.lock:
            row = self.spark.createDataFrame([(self.last + 1, kind, query, json.dumps(payload))], SCHEMA)
            row.coalesce(1).write.parquet(f"{self.path}/told-{uuid.uuid4().hex}")
            self.last += 1

    def issues(self, name: str, order: list, size: int = 10):
        """A sink for ``foreachBatch``: an issue message a row, the most urgent first by ``order``, and after each ``size`` of
        them, and after the last, a batch message with how many there are so far. The messages of a micro-batch are numbered in one task."""

        def write(df: DataFrame, batch: int) -> None:
            part = f"{self.path}/{name}-{batch}"
            held = df.persist()
            try:
                with self.lock:
                    n = held.count()
                    # the part's numbers: those it has already, or the next ones
                    again = self._exists(f"{part}/_SUCCESS")
                    base = self.spark.read.schema(SCHEMA).parquet(part).agg(F.min("sequence")).first()[0] - 1 if again and n else self.last
                    place = F.row_number().over(Window.orderBy(*order))
                    rows = held.select(F.to_json(F.struct(*df.columns)).alias("payload"), place.alias("_n"))
                    issue = rows.select((F.col("_n") + F.expr(f"(_n - 1) div {size}") + base).cast("long").alias("sequence"), F.lit("issue").alias("kind"), F.lit(name).alias("query"), "payload")
                    ends = rows.filter((F.col("_n") % size == 0) | (F.col("_n") == n))
                    ended = ends.select((F.col("_n") + F.expr(f"(_n - 1) div {size}") + 1 + base).cast("long").alias("sequence"), F.lit("batch").alias("kind"), F.lit(name).alias("query"), F.to_json(F.struct(F.lit(batch).alias("batch"), F.col("_n").alias("issues"))).alias("payload"))
                    issue.unionByName(ended).coalesce(1).write.mode("overwrite").parquet(part)
                    if not again:
                        self.last = base + n + -(-n // size)
            finally:
                held.unpersist()

        return write

    def cancel(self, query: StreamingQuery) -> None:
        """Stops a query, and says so."""
        self.cancelled.add(str(query.id))
        query.stop()


class Told(StreamingQueryListener):
    """Writes what Spark tells of queries to a log: started, progress with metrics, and how they end."""

    def __init__(self, log: MessageLog):
        self.log, self.names = log, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.log.say("started", self.names[str(event.id)])

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        name = self.names.get(p["id"], p.get("name") or p["id"])
        self.log.say("progress", name, batch=p["batchId"], rows=p["numInputRows"])
        self.log.say("metrics", name, batch=p["batchId"], rate=p.get("processedRowsPerSecond"), duration=p.get("durationMs", {}).get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id), str(event.id))
        if event.exception:
            self.log.say("error", name, message=event.exception.splitlines()[0])
        else:
            self.log.say("cancelled" if str(event.id) in self.log.cancelled else "completed", name)
