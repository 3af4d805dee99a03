"""Incremental analysis with bounded state: the last version of each of the documents used most recently.

versions(uri, version, language, content, and ``seq``, which orders them). Documents are dealt out to ``buckets``, each of which
remembers the ``capacity`` documents it has seen last: their hash, content and scopes. A document that others have pushed
out is new when it comes again, and all of its scopes are affected. One bucket is one cache for all, in
which versions are worked off one by one; more buckets work side by side.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltworks.operators.incremental import find_scopes, scope_status, text_hash
from siltworks.session import ship
from siltworks.streaming.stateful import as_rows, need_rocksdb, over_table

#: Fixed value: how many documents one cache remembers.
CAPACITY = 100
ANALYZED = "uri string, version long, seq long, change string, hash string, lines long, scopes array<struct<type:string,name:string,start_line:int,end_line:int,status:string>>"
_NAMES = ["uri", "version", "seq", "change", "hash", "lines", "scopes"]


def analyzed(row: dict, before: list | None) -> tuple[dict, list]:
    """What a version gives, and what is kept of it."""
    content = row["content"] or ""
    digest = text_hash(content)
    olds = None if before is None else (before[1], before[2])
    found = find_scopes(content, row["language"])
    status = scope_status(olds, content, row["language"], found)
    change = "new" if before is None else "same" if before[0] == digest else "changed"
    scopes = [dict(zip(("type", "name", "start_line", "end_line", "status"), (*s[:4], x))) for s, x in zip(found, status)]
    return {"uri": row["uri"], "version": row["version"], "seq": row["seq"], "change": change, "hash": digest, "lines": content.count("\n") + 1, "scopes": scopes}, [digest, content, found]


class Recent:
    """The documents of one bucket, the last used last."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def __call__(self, row: dict) -> list[dict]:
        out, kept = analyzed(row, self.held.pop(row["uri"], None))
        if len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held[row["uri"]] = kept
        return [out]


def _columns(versions: DataFrame, buckets: int | Column) -> DataFrame:
    """``buckets``: how many, or the bucket of each document."""
    bucket = buckets if isinstance(buckets, Column) else F.pmod(F.xxhash64(F.col("uri").cast("string")), F.lit(buckets))
    return versions.select(bucket.alias("bucket"), F.col("uri").cast("string"), F.col("version").cast("long"), F.col("seq").cast("long"), "language", "content")


def analyze(versions: DataFrame, capacity: int = CAPACITY, buckets: int | Column = 1) -> DataFrame:
    """uri, version, seq, change (new, changed, same), hash, lines, and the scopes with their status, of a table."""
    return over_table(_columns(versions, buckets), "bucket", ["seq"], lambda: Recent(capacity), ANALYZED)


class _Documents(StatefulProcessor):
    """State: a map of the documents (as JSON), and the order of their last use. Only documents that a micro-batch has are read and written."""

    def __init__(self, capacity: int, ttl_ms: int | None):
        self.capacity, self.ttl = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "uri string", "kept string", self.ttl)
        self.order = handle.getValueState("order", "uris string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = OrderedDict.fromkeys(json.loads(self.order.get()[0]) if self.order.exists() else [])
        now: dict[str, list] = {}
        out = []
        for row in sorted((r for pdf in rows for r in as_rows(pdf, ("version", "seq"))), key=lambda r: r["seq"]):
            uri = row["uri"] or ""
            before = None
            if uri in order:
                del order[uri]
                before = now.get(uri) or (json.loads(self.held.getValue((uri,))[0]) if self.held.containsKey((uri,)) else None)
            elif len(order) >= self.capacity:
                gone, _ = order.popitem(last=False)
                now.pop(gone, None)
                if self.held.containsKey((gone,)):
                    self.held.removeKey((gone,))
            given, now[uri] = analyzed(row, before)
            order[uri] = None
            out.append(given)
        for uri, kept in now.items():
            self.held.updateValue((uri,), (json.dumps(kept),))
        self.order.update((json.dumps(list(order)),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def analyze_stream(versions: DataFrame, capacity: int = CAPACITY, buckets: int | Column = 1, ttl_ms: int | None = None) -> DataFrame:
    """The same on a stream whose micro-batches come in order; with ``ttl_ms`` a document is also forgotten when it has not
    been used for so long, by the clock (such a query does not end by itself under the trigger ``availableNow``)."""
    need_rocksdb(versions.sparkSession)
    ship(versions.sparkSession)
    return _columns(versions, buckets).groupBy("bucket").transformWithStateInPandas(_Documents(capacity, ttl_ms), ANALYZED, "append", "none" if ttl_ms is None else "processingtime")
