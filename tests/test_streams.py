"""Operators with keyed state: over micro-batches they give what they give over the whole table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import cache, incremental, windows
from siltworks.streaming import cached, debounce, documents, messages, stateful


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    yield spark
    spark.conf.set(stateful.PROVIDER, before)


def streamed(spark, parts, tmp_path, name, apply):
    """Rows over one micro-batch for each part, in their order."""
    path = str(tmp_path / name)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    apply(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def parts_of(spark, rows, schema, n):
    size = -(-len(rows) // n)
    return [spark.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def versions(n, docs, seed):
    rng = random.Random(seed)
    names = ["alpha", "beta", "gamma"]
    out = []
    for i in range(n):
        body = "\n".join(f"def {x}():\n    return {rng.randint(0, 1)}\n\n\n\n\n\n\n" for x in names)
        out.append((i, rng.choice([f"u{rng.randint(0, docs)}", "u0", None]), i, "python", rng.choice([body, body, "", None])))
    return out


VERSIONS = "seq long, uri string, version long, language string, content string"


@pytest.mark.parametrize(("capacity", "buckets"), [(2, 1), (3, 2), (100, 1)])
def test_documents_on_a_stream(rocks, tmp_path, capacity, buckets):
    rows = [r for r in versions(60, 5, capacity) if r[1] is not None]
    batch = documents.analyze(rocks.createDataFrame(rows, VERSIONS), capacity, buckets)
    got = streamed(rocks, parts_of(rocks, rows, VERSIONS, 4), tmp_path, f"documents{capacity}", lambda s: documents.analyze_stream(s, capacity, buckets))
    assert got == rows_of(batch)


def test_documents_pushed_out_are_new_again(spark):
    rows = [(i, u, i, "python", "x = 1") for i, u in enumerate("abcab" "ccba" "a")]
    got = documents.analyze(spark.createDataFrame(rows, VERSIONS), capacity=2).orderBy("seq").collect()
    assert [r.change for r in got] == ["new", "new", "new", "new", "new", "new", "same", "same", "new", "same"]


def test_status_is_that_of_all_versions_at_once(spark):
    rows = [(s, u or "none", s, g, c) for s, u, _, g, c in versions(50, 4, 9)]
    df = spark.createDataFrame(rows, VERSIONS)
    whole = incremental.affected(df.select("uri", "version", "language", F.coalesce("content", F.lit("")).alias("content"))).select("uri", "version", "name", "start_line", "status")
    each = documents.analyze(df).select("uri", "version", F.explode("scopes").alias("s")).select("uri", "version", "s.name", "s.start_line", "s.status")
    assert rows_of(each) == rows_of(whole)


@pytest.mark.parametrize("late", [0, 40])
def test_debounce_on_a_stream(rocks, tmp_path, late):
    """Only the last row of a burst comes out, in whatever micro-batch the next burst begins."""
    rng, at, rows = random.Random(late), 0, []
    for i in range(160):
        at += rng.choice([1, 2, 3, 9, 10, 11, 30])
        rows.append((f"k{rng.randint(0, 3)}", i, at, rng.choice([None, "x", "é\n"])))
    if late:  # rows come up to 40 seconds after their time
        rows.sort(key=lambda r: r[2] + rng.randint(0, 30))
    rows.append(("end", 999, at + 10_000, "x"))
    schema = "key string, seq long, s long, text string"
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    whole = timed(rocks.createDataFrame(rows, schema))
    want = windows.debounce(whole, "key", "ts", 10).filter("key <> 'end'")
    parts = [timed(p) for p in parts_of(rocks, rows, schema, 6)]
    got = streamed(rocks, parts, tmp_path, f"bursts{late}", lambda s: debounce.debounce(s, "key", "ts", 10, f"{late} seconds", "seq"))
    assert got == rows_of(want) and len(got) > 20


OPS = "seq long, op string, key string, at long, ttl long, priority long, tier string"


def operations(n, seed):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 1000, 60_000, 200_000, 400_000])
        op = rng.choice(["get"] * 5 + ["set", "set", "delete"])
        rows.append((i, op, f"k{rng.randint(0, 4)}", at, rng.choice([None, 0, 100_000, 900_000]), rng.choice([None, 1, 2, 3]), rng.choice([None, "memory", "persistent"])))
    return rows


def test_cache_on_a_stream(rocks, tmp_path):
    rows = operations(400, 5)
    whole = cached.replay(rocks.createDataFrame(rows, OPS))
    got = streamed(rocks, parts_of(rocks, rows, OPS, 5), tmp_path, "cached", cached.replay_stream)
    assert got == rows_of(whole)
    assert {r.result for r in whole.collect()} == {"hit", "stale", "miss"} and whole.filter("promoted").count() > 3


def test_cache_as_lookups_of_a_table(spark):
    """Each key asked once: what the states say is what a join with the entries says."""
    rng = random.Random(8)
    entries = [(f"k{i}", rng.choice(["memory", "persistent"]), rng.choice([None, 100_000, 500_000, 900_000])) for i in range(60)]
    ops = [(i, "set", k, 0, 0 if end is None else end, 1, tier) for i, (k, tier, end) in enumerate(entries)]
    asked = [(100 + i, f"k{i + 5}", rng.choice([50_000, 600_000, 900_000, 1_150_000])) for i in range(60)]
    ops += [(a, "get", k, at, None, None, None) for a, k, at in asked]
    looked = cache.lookups(spark.createDataFrame(asked, "ask long, key string, ms long").select("ask", "key", F.timestamp_millis("ms").alias("at")), spark.createDataFrame(entries, "key string, tier string, end long").select("key", "tier", F.timestamp_millis("end").alias("expires_at")))
    got = cached.replay(spark.createDataFrame(ops, OPS)).select("seq", "key", "tier", "result", "promoted")
    assert rows_of(got) == rows_of(looked.select("ask", "key", "tier", "result", "promoted"))


def test_a_store_without_timers_is_refused(rocks):
    rocks.conf.set(stateful.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            debounce.debounce(rocks.readStream.format("rate").load(), "value", "timestamp", 1)
    finally:
        rocks.conf.set(stateful.PROVIDER, stateful.ROCKSDB)


def test_messages_of_all_kinds_over_a_restart(spark, tmp_path):
    """Three queries: one ends, one fails, one is cancelled; then the log goes on where it was."""
    schema = "seq long, severity string"
    rows = [(i, s) for i, s in enumerate(["low", "high", "critical"] * 4)]
    for i in range(2):
        spark.createDataFrame(rows[6 * i : 6 * i + 6], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)

    def run(log, name, sink, check):
        return stream().writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()

    def told(log, work):
        listener = messages.Told(log)
        spark.streams.addListener(listener)
        try:
            work()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        finally:
            spark.streams.removeListener(listener)

    def broken(df, batch):
        raise RuntimeError("sink is gone")

    log = messages.MessageLog(spark, str(tmp_path / "log"))
    sink = log.issues("good", [rank, F.col("seq")], 4)

    def first():
        run(log, "good", sink, "good").awaitTermination()
        with pytest.raises(Exception, match="sink is gone"):
            run(log, "bad", broken, "bad").awaitTermination()
        log.cancel(spark.readStream.format("rate").load().writeStream.queryName("endless").format("noop").start())

    told(log, first)
    before = log.read().orderBy("sequence").collect()
    assert {m.kind for m in before} == set(messages.KINDS)
    assert [m.sequence for m in before] == list(range(1, len(before) + 1))
    issues = [json.loads(m.payload)["severity"] for m in before if m.kind == "issue"]
    assert issues == ["critical"] * 2 + ["high"] * 2 + ["low"] * 2 + ["critical"] * 2 + ["high"] * 2 + ["low"] * 2
    assert [json.loads(m.payload)["issues"] for m in before if m.kind == "batch"] == [4, 6, 4, 6]
    # another process: a batch that comes again changes nothing, what is new goes on from the last number
    again = messages.MessageLog(spark, str(tmp_path / "log"))
    again.issues("good", [rank, F.col("seq")], 4)(spark.createDataFrame(rows[6:], schema), 1)
    assert [tuple(m) for m in again.read().orderBy("sequence").collect()] == [tuple(m) for m in before]
    again.issues("good", [rank, F.col("seq")], 4)(spark.createDataFrame(rows[:1], schema), 2)
    again.say("completed", "good")
    after = [m.sequence for m in again.read().orderBy("sequence").collect()]
    assert after == list(range(1, len(before) + 4))
