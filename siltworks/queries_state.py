"""Queries on caches, monitoring and state machines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siltworks.functions import severity
from siltworks.operators import cache as C
from siltworks.operators import monitor as M
from siltworks.operators import state
from siltworks.operators import views as V
from siltworks.registry import query as registered
from siltworks.registry import table
from siltworks.streaming import delivery


def query(sql: str):
    """``at`` is a column here and a keyword there."""
    return registered(re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql))


_NOW = "2024-02-01 00:00:00"
#: One entry a customer; each market segment is a cache.
_ENTRIES = {
    "key": "concat('k', CAST(c_custkey AS STRING))",
    "cache": "c_mktsegment",
    "size": "(c_custkey * 7919) % 900 + 100",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(c_custkey % 700 AS INT), 0, 0)",
    "accessed_at": "TIMESTAMP '2024-01-30 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST((c_custkey * 37) % 2879 AS INT), 0)",
    "expires_at": "CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-31 23:50:00' + make_interval(0, 0, 0, 0, 0, CAST(c_custkey % 20 AS INT), 0) END",
    "access_count": "(c_custkey * 31) % 17",
    "priority": "c_custkey % 4 + 1",
    "tier": "CASE c_custkey % 3 WHEN 0 THEN 'memory' ELSE 'persistent' END",
    "seq": "c_custkey",
}


def _duck(x: str) -> str:
    return x.replace("STRING", "VARCHAR").replace("make_interval(0, 0, 0, 0, CAST(c_custkey % 700 AS INT), 0, 0)", "to_hours(CAST(c_custkey % 700 AS INT))").replace("make_interval(0, 0, 0, 0, 0, CAST((c_custkey * 37) % 2879 AS INT), 0)", "to_minutes(CAST((c_custkey * 37) % 2879 AS INT))").replace("make_interval(0, 0, 0, 0, 0, CAST(c_custkey % 20 AS INT), 0)", "to_minutes(CAST(c_custkey % 20 AS INT))")


_E = "SELECT " + ", ".join(f"{_duck(x)} AS {n}" for n, x in _ENTRIES.items()) + ", CASE c_custkey % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b'] WHEN 2 THEN NULL ELSE [] END AS tags FROM customer"
_NOW_SQL = f"TIMESTAMP '{_NOW}'"
_AGE = lambda c: f"((epoch_us({_NOW_SQL}) - epoch_us({c})) / 1000000)"


def entries(spark, sf):
    tags = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("b"))).when(F.col("c_custkey") % 4 == 3, F.array().cast("array<string>"))
    return table(spark, sf, "customer").select(*(F.expr(x).alias(n) for n, x in _ENTRIES.items()), tags.alias("tags"))


def now():
    return F.lit(_NOW).cast("timestamp")


_SMART = f"0.1 * {_AGE('created_at')} / 3600 + 0.3 * {_AGE('accessed_at')} / 60 + 0.2 / ln(access_count + 2) + 0.2 / priority + 0.1 * size / 20000 * 10 + 0.1 * CASE WHEN expires_at IS NOT NULL THEN greatest(0, {_AGE('expires_at')} / 60) ELSE 0 END"
_POLICIES = {"lru": "epoch_us(accessed_at)", "lfu": "access_count", "arc": f"{_AGE('accessed_at')} * 0.5 + 1000 * 0.5 / (access_count + 1)", "smart": f"-({_SMART})"}


def _order(policy: str) -> str:
    return f"SELECT '{policy}' AS policy, key, row_number() OVER (PARTITION BY cache ORDER BY round({_POLICIES[policy]}, 9), seq) AS victim FROM ({_E})" + (" WHERE priority <= 2" if policy == "arc" else "")


@query(" UNION ALL ".join(map(_order, _POLICIES)))
def eviction_order(spark, sf):
    parts = [C.eviction_order(entries(spark, sf), p, now(), ["cache"], 20000).select(F.lit(p).alias("policy"), "key", F.col("victim").cast("long")) for p in _POLICIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT key, round({_SMART}, 6) AS score FROM ({_E})")
def eviction_rank(spark, sf):
    return C.eviction_order(entries(spark, sf), "smart", now(), ["cache"], 20000).select("key", F.round(-F.col("score"), 6).alias("score"))


@query(f"SELECT key, cache FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY cache ORDER BY accessed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER (PARTITION BY cache) + 500 - 12000 AS over FROM ({_E})) WHERE freed < over")
def cache_evicted(spark, sf):
    return C.evicted(entries(spark, sf), "lru", now(), 500, ["cache"], 12000).select("key", "cache")


@query(f"SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY accessed_at DESC, seq DESC) AS n FROM ({_E})) WHERE n <= 10")
def cache_kept(spark, sf):
    return C.over_count(entries(spark, sf), 10, ["cache"]).select("key")


_STATUS = lambda at: f"CASE WHEN expires_at IS NULL OR epoch_us({at}) <= epoch_us(expires_at) THEN 'fresh' WHEN epoch_us({at}) - epoch_us(expires_at) <= 300000000 THEN 'stale' ELSE 'expired' END"


@query(f"SELECT key, {_STATUS(_NOW_SQL)} AS status FROM ({_E})")
def cache_status(spark, sf):
    return entries(spark, sf).select("key", C.status(F.col("expires_at"), now()).alias("status"))


@query(f"SELECT count(*) AS n, sum(size)::BIGINT AS size FROM ({_E}) WHERE expires_at IS NULL OR expires_at >= {_NOW_SQL}")
def cache_saved(spark, sf):
    return C.live(entries(spark, sf), now()).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


_ASKED = "SELECT event_id AS ask, 'k' || (event_id % 3000) AS key, TIMESTAMP '2024-01-31 23:45:00' + to_minutes(CAST(event_id % 40 AS INT)) AS at FROM events"
_LOOKED = f"SELECT ask, CASE WHEN best IS NULL THEN 'miss' WHEN best[2] = 'fresh' THEN 'hit' ELSE 'stale' END AS result, CASE best[1] WHEN '0' THEN 'memory' WHEN '1' THEN 'persistent' END AS tier FROM (SELECT ask, min(CASE WHEN s IN ('fresh', 'stale') THEN [CASE tier WHEN 'memory' THEN '0' ELSE '1' END, s] END) AS best FROM (SELECT ask, tier, CASE WHEN e.key IS NOT NULL THEN {_STATUS('at')} END AS s FROM ({_ASKED}) a LEFT JOIN ({_E}) e ON a.key = e.key) GROUP BY ask)"


def asked(spark, sf):
    at = F.expr("TIMESTAMP '2024-01-31 23:45:00' + make_interval(0, 0, 0, 0, 0, CAST(event_id % 40 AS INT), 0)")
    return table(spark, sf, "events").select(F.col("event_id").alias("ask"), F.concat(F.lit("k"), (F.col("event_id") % 3000).cast("string")).alias("key"), at.alias("at"))


@query(f"SELECT ask, result, tier, coalesce(tier = 'persistent', false) AS promoted FROM ({_LOOKED})")
def cache_lookups(spark, sf):
    return C.lookups(asked(spark, sf), entries(spark, sf)).select("ask", "result", "tier", "promoted")


@query(f"SELECT tier, count(*) AS n FROM (SELECT tier FROM ({_E}) UNION ALL SELECT 'memory' FROM ({_E}) e WHERE tier = 'persistent' AND EXISTS (SELECT 1 FROM ({_LOOKED}) l JOIN ({_ASKED}) a USING (ask) WHERE l.tier = 'persistent' AND a.key = e.key)) GROUP BY 1")
def cache_promoted(spark, sf):
    e = entries(spark, sf)
    return C.promoted(e, C.lookups(asked(spark, sf), e)).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(tier, 'none') AS tier, count(*) FILTER (result <> 'miss') AS hits, count(*) FILTER (result = 'miss') AS misses, round(count(*) FILTER (result <> 'miss') / count(*), 6) AS hit_rate FROM ({_LOOKED}) GROUP BY 1")
def cache_hit_rates(spark, sf):
    looked = C.lookups(asked(spark, sf), entries(spark, sf)).withColumn("tier", F.coalesce("tier", F.lit("none")))
    return C.hit_rates(looked, "tier")


@query(f"SELECT tier, count(*) AS entries, sum(size)::BIGINT AS size, round(sum(size) / 629145600, 9) AS utilization FROM ({_E}) GROUP BY 1")
def cache_utilization(spark, sf):
    return C.utilization(entries(spark, sf), "tier")


@query(f"SELECT key FROM ({_E}) WHERE NOT (coalesce(list_contains(tags, 'a'), false) AND tier = 'memory')")
def cache_invalidated(spark, sf):
    return C.invalidated(entries(spark, sf), "a").select("key")


@query("SELECT c_mktsegment, sum(2 * length('k' || c_custkey) + 2 * length(c_name) + 32)::BIGINT AS bytes FROM customer GROUP BY 1")
def cache_size_estimate(spark, sf):
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sum(C.size_estimate(key, F.col("c_name"))).alias("bytes"))


@query("SELECT doc_id, CASE WHEN n > 10240 AND z < n * 0.9 THEN z ELSE n END AS stored FROM (SELECT doc_id, 2 * length(text) AS n, length(regexp_replace(text, '[aeiou]', '', 'g')) * (doc_id % 3 + 1) AS z FROM documents WHERE text IS NOT NULL)")
def cache_stored_size(spark, sf):
    """Whole texts, and what is left of them without vowels for a compressed form."""
    d = table(spark, sf, "documents").filter("text is not null")
    packed = F.length(F.regexp_replace("text", "[aeiou]", "")) * (F.col("doc_id") % 3 + 1)
    return d.select("doc_id", C.stored_size(2 * F.length("text"), packed).cast("long").alias("stored"))


@query("SELECT doc_id, 'analysis:' || substr(sha256('{\"codeHash\":\"' || sha256(text) || '\"' || CASE WHEN lang IS NOT NULL THEN ',\"language\":\"' || lang || '\"' ELSE '' END || '}'), 1, 16) AS key FROM documents WHERE text IS NOT NULL")
def cache_request_key(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", C.request_key("analysis", F.sha2("text", 256).alias("codeHash"), F.col("lang").alias("language")).alias("key"))


# monitoring: each event starts an operation; most end
_STARTS = "SELECT event_id AS id, event_type || CASE event_id % 3 WHEN 0 THEN '-analysis' ELSE '' END AS name, ts AS at, event_type AS kind FROM events"
_STOPS = "SELECT event_id AS id, ts + to_milliseconds(((value * 37) % 5000)::INT) AS at, event_type <> 'error' AS ok FROM events WHERE event_id % 7 > 0"
_TIMED = f"SELECT s.*, p.ok, epoch_ms(p.at) - epoch_ms(s.at) AS duration, p.at AS ended FROM ({_STARTS}) s LEFT JOIN ({_STOPS}) p USING (id)"


def timed(spark, sf):
    e = table(spark, sf, "events")
    starts = e.select(F.col("event_id").alias("id"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "-analysis").otherwise("")).alias("name"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    end = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.bround((F.col("value") * 37) % 5000).cast("long"))
    stops = e.filter("event_id % 7 > 0").select(F.col("event_id").alias("id"), end.alias("at"), (F.col("event_type") != "error").alias("ok"))
    return M.timers(starts, stops).withColumn("ended", F.timestamp_millis(F.unix_millis(F.col("at").cast("timestamp")) + F.col("duration")))


@query(f"SELECT kind, count(ok) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) - count(ok) AS pending FROM ({_TIMED}) GROUP BY 1")
def operation_counts(spark, sf):
    return M.operations(timed(spark, sf), "kind")


@query(
    f"SELECT kind, count(*) AS n, round(avg(duration), 6) AS mean, min(duration) AS least, max(duration) AS most, round(sum(duration), 4)::BIGINT AS total, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99 "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY at DESC, id DESC) AS r FROM ({_TIMED}) WHERE contains(name, 'analysis') AND duration IS NOT NULL) WHERE r <= 50 GROUP BY 1"
)
def analysis_times(spark, sf):
    d = M.distribution(M.analysis_times(timed(spark, sf)), "duration", ["kind"], ["at", "id"], 50)
    return d.withColumns({p: F.col(p).cast("long") for p in ("p50", "p95", "p99")})


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_stats(spark, sf):
    return M.distribution(table(spark, sf, "events"), "value", ["event_type"])


_AT = "TIMESTAMP '2024-01-20 12:00:00'"


@query(f"SELECT event_type, coalesce(sum(user_id) FILTER (epoch_ms(ts) BETWEEN epoch_ms({_AT}) - 86400000 AND epoch_ms({_AT})), 0)::BIGINT AS count, round(coalesce(sum(user_id) FILTER (epoch_ms(ts) BETWEEN epoch_ms({_AT}) - 86400000 AND epoch_ms({_AT})), 0) / 86400, 9) AS rate FROM events GROUP BY 1")
def counter_rates(spark, sf):
    return M.counter_rate(table(spark, sf, "events"), F.lit("2024-01-20 12:00:00").cast("timestamp"), "user_id", "ts", ["event_type"], 86400)


@query(f"SELECT kind, errors, total, round(CASE WHEN total > 0 THEN errors / total ELSE 0 END, 9)::DOUBLE AS rate FROM (SELECT kind, count(*) FILTER (NOT ok AND epoch_ms(ended) BETWEEN epoch_ms({_AT}) - 86400000 AND epoch_ms({_AT})) AS errors, count(ok) FILTER (epoch_ms(ended) <= epoch_ms({_AT})) AS total FROM ({_TIMED}) GROUP BY 1)")
def error_rates(spark, sf):
    return M.error_rate(timed(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp"), ["kind"], 86400)


@query(f"SELECT (SELECT count(*) FROM ({_TIMED}) WHERE contains(name, 'analysis') AND duration IS NOT NULL) AS timed, (SELECT round(count(*) FILTER (result <> 'miss') / count(*), 6) FROM ({_LOOKED})) AS hit_rate, (SELECT count(*) FILTER (NOT ok AND epoch_ms(ended) BETWEEN epoch_ms({_AT}) - 86400000 AND epoch_ms({_AT})) FROM ({_TIMED})) AS errors")
def performance_snapshot(spark, sf):
    t, at = timed(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp")
    hits = C.hit_rates(C.lookups(asked(spark, sf), entries(spark, sf)))
    rates = M.counter_rate(table(spark, sf, "events"), at, "user_id", "ts", (), 86400)
    s = M.snapshot(M.distribution(M.analysis_times(t), "duration"), rates, M.error_rate(t, at, (), 86400), hits, at)
    return s.select(F.col("metrics.analysisTime.n").alias("timed"), F.col("metrics.cache.hit_rate").alias("hit_rate"), F.col("metrics.errors.errors").alias("errors"))


_HOURLY = "SELECT event_type AS metric, epoch(date_trunc('hour', ts))::DOUBLE AS at, avg(value) AS value FROM events GROUP BY ALL"


def hourly(spark, sf):
    h = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("value"))
    return h.select("metric", F.unix_seconds(F.col("h").cast("timestamp")).cast("double").alias("at"), "value")


def _alarms(warn: int, critical: int) -> str:
    return _ALARMS.replace(">= 80", f">= {critical}").replace(">= 60", f">= {warn}")


_ALARMS = (
    f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY at) AS n, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'warning' END AS lv FROM ({_HOURLY})), "
    "r AS (SELECT metric, n, at, value, lv AS level, CASE WHEN lv IS NOT NULL THEN at ELSE -1e18 END AS last, lv IS NOT NULL AS open FROM s WHERE n = 1 "
    "UNION ALL SELECT s.metric, s.n, s.at, s.value, CASE WHEN s.at - r.last < 7200 THEN NULL WHEN s.lv IS NOT NULL THEN s.lv WHEN r.open THEN 'resolved' END, CASE WHEN s.at - r.last >= 7200 AND s.lv IS NOT NULL THEN s.at ELSE r.last END, "
    "CASE WHEN s.at - r.last < 7200 THEN r.open ELSE s.lv IS NOT NULL END FROM r JOIN s ON s.metric = r.metric AND s.n = r.n + 1) "
)


@query(_ALARMS + "SELECT metric, at, level, round(value, 6) AS value FROM r WHERE level IS NOT NULL")
def alerts(spark, sf):
    return state.alerts(hourly(spark, sf), 60, 80, 7200).withColumn("value", F.round("value", 6))


@query(_alarms(20, 40) + "SELECT metric, level FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY at DESC) AS k FROM r WHERE level IS NOT NULL) WHERE k = 1 AND level <> 'resolved'")
def unresolved_alerts(spark, sf):
    return M.unresolved(state.alerts(hourly(spark, sf), 20, 40, 7200)).select("metric", "level")


_CALLS = "SELECT user_id % 10 AS endpoint, event_id AS seq, epoch_ms(ts) / 1000 AS at, event_type <> 'error' AS ok FROM events"


@query(
    f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY at, seq) AS n FROM ({_CALLS})), "
    "r AS (SELECT endpoint, 0::BIGINT AS n, 0::BIGINT AS seq, 'closed' AS state, []::DOUBLE[] AS recent, 0 AS good, 0::DOUBLE AS nxt FROM (SELECT DISTINCT endpoint FROM s) "
    "UNION ALL SELECT endpoint, n, seq, CASE WHEN before = 'open' THEN 'open' WHEN ok AND before = 'half-open' THEN CASE WHEN good + 1 >= 2 THEN 'closed' ELSE 'half-open' END WHEN ok THEN before WHEN before = 'half-open' OR len(fails) >= 5 THEN 'open' ELSE before END, "
    "CASE WHEN before = 'open' THEN recent WHEN ok AND before = 'half-open' THEN CASE WHEN good + 1 >= 2 THEN [] ELSE recent END WHEN ok THEN [] ELSE fails END, CASE WHEN ok AND before = 'half-open' THEN good + 1 ELSE good END, "
    "CASE WHEN before <> 'open' AND NOT ok AND (before = 'half-open' OR len(fails) >= 5) THEN at + 3600 ELSE nxt END FROM (SELECT s.endpoint, s.n, s.seq, s.at, s.ok, r.recent, r.nxt, CASE WHEN r.state = 'open' AND s.at >= r.nxt THEN 'half-open' ELSE r.state END AS before, "
    "CASE WHEN r.state = 'open' THEN 0 ELSE r.good END AS good, list_filter(list_append(r.recent, s.at), lambda t: t > s.at - 86400) AS fails FROM r JOIN s ON s.endpoint = r.endpoint AND s.n = r.n + 1)) "
    "SELECT endpoint, seq, state FROM r WHERE n > 0"
)
def circuit_breaker(spark, sf):
    e = table(spark, sf, "events")
    calls = e.select((F.col("user_id") % 10).alias("endpoint"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return state.circuit_breaker(calls, failures=5, window=86400, wait=3600).select("endpoint", "seq", "state")


@query("SELECT conv_id::VARCHAR AS uri, turn AS version, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'new' WHEN lag(text) OVER w IS NOT DISTINCT FROM text THEN 'same' ELSE 'changed' END AS change FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'the same' ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, turn + 100, text FROM conversations WHERE turn % 3 = 1) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def document_changes(spark, sf):
    """Whole turns as versions; some are like the one before."""
    c = table(spark, sf, "conversations")
    versions = c.select(F.col("conv_id").alias("uri"), F.col("turn").alias("version"), F.when(F.col("turn") % 3 == 0, "the same").otherwise(F.col("text")).alias("content"))
    c = versions.unionByName(c.filter("turn % 3 = 1").select(F.col("conv_id").alias("uri"), (F.col("turn") + 100).alias("version"), F.col("text").alias("content")))
    return state.document_changes(c).select("uri", "version", "change")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'healthy' WHEN n_nationkey % 3 = 1 THEN 'unhealthy' ELSE 'degraded' END AS status FROM nation")
def system_health(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    parts = M.component_status(F.when(k % 3 == 2, 0).otherwise(2), F.lit(0.9), F.when(k % 3 == 1, 3).otherwise(0), F.when(k % 3 == 1, 1).otherwise(0))
    return M.health(n.select("n_nationkey", F.explode(parts).alias("c")).select("n_nationkey", "c.status"), "n_nationkey")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') = 0 AS ok, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'Batch failed: ' || count(*) FILTER (o_orderstatus = 'F') || '/' || count(*) || ' tasks failed' END AS message FROM orders GROUP BY 1")
def batch_outcomes(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "error").alias("error"))
    return M.batch_outcome(o, "o_custkey")


@query("SELECT o_custkey % 50 AS queue, count(*) FILTER (o_orderkey % 4 = 0) AS pending, count(*) FILTER (o_orderkey % 4 = 1) AS active, count(*) FILTER (o_orderkey % 4 = 2) AS completed, count(*) FILTER (o_orderkey % 4 = 3) AS failed FROM orders GROUP BY 1")
def queue_status(spark, sf):
    states = F.element_at(F.array(*map(F.lit, ("pending", "active", "completed", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return M.queue_status(table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("queue"), states.alias("state")), "queue")


_BEFORE = "[0, 5, 20, 45, 65, 80, 90, 95]"
_WEIGHT = "[5, 15, 25, 20, 15, 10, 5, 5]"


@query(
    f"SELECT event_id, round(percent, 6) AS percent, round(CASE WHEN percent > 0 THEN greatest(0, value * 1000 / percent * 100 - value * 1000) END, 3) AS remaining FROM (SELECT event_id, value, least(99, {_BEFORE}[event_id % 8 + 1] + {_WEIGHT}[event_id % 8 + 1] * CASE WHEN event_id % 6 > 0 THEN (event_id % 5) / 5 ELSE 0 END)::DOUBLE AS percent FROM events)"
)
def phase_progress(spark, sf):
    phase = F.element_at(F.array(*(F.lit(p) for p, _ in M.PHASES)), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, sf, "events").withColumn("percent", M.progress(phase, F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 5).otherwise(0), F.when(F.col("event_id") % 6 > 0, 5).otherwise(0)))
    return e.select("event_id", F.round("percent", 6).alias("percent"), F.round(M.remaining_ms(F.col("value") * 1000, F.col("percent")), 3).alias("remaining"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events")
def message_numbers(spark, sf):
    return M.numbered(table(spark, sf, "events"), ["ts", "event_id"], ["user_id"], 10).select("event_id", F.col("sequence").cast("long"), "batch")


@query("SELECT event_id, slot, (row_number() OVER (PARTITION BY user_id, slot ORDER BY ts) - 1) // 3 AS batch FROM (SELECT *, (epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY user_id)) // 86400000 AS slot FROM events)")
def flush_batches(spark, sf):
    return M.timed_batches(table(spark, sf, "events"), "ts", ["user_id"], 3, 86400).select("event_id", "slot", "batch")


@query("SELECT event_type, day::VARCHAR AS day, round((n - lag(n) OVER w) / ((epoch_ms(day) - epoch_ms(lag(day) OVER w)) / 1000), 9) AS per_second FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, sum(value) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def task_throughput(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("n"))
    return M.throughput(e.withColumn("at", F.col("day").cast("timestamp")), ["event_type"], "at", "n").select("event_type", F.col("day").cast("string").alias("day"), "per_second")


@query("SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%g') || 'Z] [' || ['DEBUG', 'INFO', 'WARN', 'ERROR'][event_id % 4 + 1] || '] ' || event_type AS line FROM events WHERE event_id % 4 >= 2")
def log_export(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 4).cast("int").alias("level"), F.col("event_type").alias("message"))
    return V.log_lines(M.logged(e, 2)).select(F.col("seq").alias("event_id"), "line")


_URGENCY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END"


@query(f"SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY CASE {_URGENCY} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_id) - 1) // 10 AS delivery FROM events")
def priority_delivery(spark, sf):
    rows = table(spark, sf, "events").withColumn("severity", F.expr(_URGENCY))
    return delivery.prioritized(rows, severity.rank(F.col("severity")), ["event_id"], by=["user_id"]).select("event_id", "delivery")


@query("SELECT event_id, '{\"type\":\"event\",\"payload\":{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}}' AS line FROM events")
def stream_lines(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    lines = delivery.lines(e, "event")
    return lines.select(F.get_json_object("value", "$.payload.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))
