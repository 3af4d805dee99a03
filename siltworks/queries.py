"""The registered queries of the engine's operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import scoring, severity, text
from siltworks.operators import joins, match, windows
from siltworks.oracles import positions
from siltworks.plans import rules
from siltworks.registry import QUERIES, SQL, lit, query, table
from siltworks.session import spread
from siltworks.sources import reports
from siltworks.streaming import rates

_RE = {r.id: r.patterns[0].regex for r in rules.CORPUS_PACK}
_SEV = {r.id: r.severity for r in rules.CORPUS_PACK}
#: One row a match and rule, in DuckDB.
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, source, '{i}' AS rule_id, '{_SEV[i]}' AS severity, m FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '{r}')) AS m FROM documents)" for i, r in _RE.items()
)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE -1 END"


def corpus_findings(spark, sf, keep=()) -> DataFrame:
    return match.scan(table(spark, sf, "documents"), rules.CORPUS_PACK, "doc_id", "text", keep=keep)


@query(f"SELECT source, rule_id, severity, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM ({_HITS}) GROUP BY ALL")
def corpus_scan_by_source(spark, sf):
    found = match.best_of_place(corpus_findings(spark, sf, ["source"]), "doc_id")
    return found.groupBy("source", "rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT doc_id, rule_id, line, count(*) AS n, sum(length(m))::BIGINT AS chars FROM (" + " UNION ALL ".join(f"SELECT key AS doc_id, '{i}' AS rule_id, m, line FROM ({positions(r, 'SELECT doc_id AS key, text AS body FROM documents')})" for i, r in _RE.items()) + ") GROUP BY ALL")
def finding_lines(spark, sf):
    return corpus_findings(spark, sf).groupBy("doc_id", "rule_id", "line").agg(F.count("*").alias("n"), F.sum(F.length("match")).alias("chars"))


@query(f"SELECT doc_id, rule_id, round(least(1.0, 0.7 + CASE WHEN length(m) > 50 THEN 0.1 ELSE 0 END + CASE WHEN length(m) > 100 THEN 0.1 ELSE 0 END + CASE severity WHEN 'critical' THEN 0.1 WHEN 'high' THEN 0.05 ELSE 0 END), 6)::DOUBLE AS confidence, length(m)::BIGINT AS size FROM ({_HITS})")
def finding_confidence(spark, sf):
    return corpus_findings(spark, sf).select("doc_id", "rule_id", "confidence", F.length("match").cast("long").alias("size"))


@query(f"SELECT severity, {_RANK}::INT AS rank, count(*) AS n FROM ({_HITS}) GROUP BY ALL HAVING rank <= 2")
def min_severity_filter(spark, sf):
    found = corpus_findings(spark, sf).filter(severity.at_least(F.col("severity"), "medium"))
    return found.groupBy("severity").agg(severity.rank(F.first("severity")).alias("rank"), F.count("*").alias("n"))


# Code samples for the rules on source text.
SAMPLES = (
    ("s01", "javascript", 'db.query("SELECT * FROM t WHERE id=" + req.params.id)'),
    ("s02", "javascript", "document.write(name)"),
    ("s03", "python", "subprocess.run(cmd, shell=True)"),
    ("s04", "javascript", "fs.readFile(req.query.path)"),
    ("s05", "python", 'api_key = "abcd1234efgh"'),
    ("s06", "python", "pickle.loads(data)"),
    ("s07", "python", "etree.parse(f)"),
    ("s08", "javascript", "fetch(req.body.url)"),
    ("s09", "javascript", "createHash('md5')"),
    ("s10", "javascript", "db.users(req.body)"),
    ("s11", "javascript", "o.__proto__ = x"),
    ("s12", "javascript", "Math.random()"),
    ("s13", "javascript", "res.redirect(req.query.next)"),
    ("s14", "javascript", "app.get('/admin', handler)"),
    ("s15", "javascript", "origin: '*'"),
    ("s16", "java", "DocumentBuilderFactory f = g();\nf.newDocumentBuilder(); el.innerHTML = x"),
    ("n01", "javascript", "el.textContent = name"),
    ("n02", "python", 'password = "placeholder1"'),
    ("d01", "javascript", "document.write(name)\n  Math.random()"),
)


def code_samples(spark, sf):
    """One sample a customer, by turns."""
    of = lambda part: F.element_at(F.array(*(F.lit(x[part]) for x in SAMPLES)), (F.col("c_custkey") % len(SAMPLES) + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), of(1).alias("language"), of(2).alias("content"))


def _expected() -> list[tuple]:
    """What another regex engine finds in the samples: sample, rule, severity, line, column, confidence, snippet, most confident and first of a place."""
    best: dict[tuple, tuple] = {}
    for at, (_, language, code) in enumerate(SAMPLES):
        for n, rule in enumerate(sorted(rules.BUILT_IN, key=lambda r: r.priority)):
            if language not in rule.languages and "*" not in rule.languages:
                continue
            for k, p in enumerate(rule.patterns):
                for m in re.finditer(p.regex, code):
                    if not m[0] or any(re.search(x, m[0], re.I) for x in p.negative):
                        continue
                    before = code[: m.start()]
                    line, col = before.count("\n") + 1, len(before.rpartition("\n")[2])
                    sure = round(min(1.0, 0.7 + 0.1 * (len(m[0]) > 50) + 0.1 * (len(m[0]) > 100) + {"critical": 0.1, "high": 0.05}.get(rule.severity, 0)), 6)
                    old = best.get((at, rule.id, line, col))
                    if old is None or sure > old[0]:
                        snippet = "\n".join(code.split("\n")[max(0, line - 2) : line + 2])
                        best[at, rule.id, line, col] = (sure, rule.severity, rule.name, snippet, 100 * n + k)
    return [(at, rid, sev, line, col, sure, name, snippet) for (at, rid, line, col), (sure, sev, name, snippet, _) in best.items()]


@query("SELECT c_custkey AS file, rule_id, severity, line, col, confidence, name, snippet FROM customer JOIN (VALUES " + ", ".join(f"({a}, {lit(r)}, {lit(s)}, {ln}::BIGINT, {c}::BIGINT, {x}::DOUBLE, {lit(n)}, {lit(t)})" for a, r, s, ln, c, x, n, t in _expected()) + f") AS t(sample, rule_id, severity, line, col, confidence, name, snippet) ON c_custkey % {len(SAMPLES)} = t.sample")
def builtin_rules(spark, sf):
    found = match.scan(code_samples(spark, sf), rules.BUILT_IN, "file", "content", "language", details=True)
    return match.ordered(match.best_of_place(found, "file")).select("file", "rule_id", "severity", "line", "col", "confidence", "name", "snippet")


@query("SELECT page_id, count(*) AS lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS t FROM pages) WHERE regexp_matches(t, '<script') GROUP BY page_id")
def html_tag_lines(spark, sf):
    rule = rules.Rule("HTML1", "Script tag", "low", "html", (rules.Pattern("<script"),))
    return match.line_scan(table(spark, sf, "pages"), [rule], "page_id", "html").groupBy("page_id").agg(F.count("*").alias("lines"))


def _chain_sql(col, chain):
    for p, m in chain:
        col = f"regexp_replace({col}, '{p}', '{m.replace('$1', chr(92) + '1')}', 'g')"
    return col


@query(f"SELECT doc_id, sha256({_chain_sql('text', text.ERROR_CHAIN)}) AS digest, length({_chain_sql('text', text.ERROR_CHAIN)})::BIGINT AS size FROM documents")
def redact_documents(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.redact(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("size"))


@query(f"SELECT conv_id, turn, sha256({_chain_sql('text', text.TELEMETRY_CHAIN)}) AS digest FROM conversations")
def redact_conversations(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(text.redact(F.col("text"), text.TELEMETRY_CHAIN), 256).alias("digest"))


@query(f"SELECT page_id, sha256({_chain_sql('html', text.STACK_CHAIN)}) AS digest FROM pages")
def redact_stacks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.redact(F.col("html"), text.STACK_CHAIN), 256).alias("digest"))


@query("SELECT page_id, '<path-depth-' || len(regexp_split_to_array(url, '[/\\\\]')) || '>/<file>' || CASE WHEN contains(regexp_split_to_array(url, '[/\\\\]')[-1], '.') THEN '.' || string_split(regexp_split_to_array(url, '[/\\\\]')[-1], '.')[-1] ELSE '' END AS path, regexp_matches(url, '[/\\\\]|^[~.]') AS is_path FROM pages")
def path_anonymize(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.anonymize_path(F.col("url")).alias("path"), text.looks_like_path(F.col("url")).alias("is_path"))


@query("SELECT event_type, regexp_replace(event_type || ' #' || user_id, '[^a-zA-Z0-9_.-]', '_', 'g') AS name, count(*) AS n FROM events GROUP BY ALL")
def event_names(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_type", text.clean_name(F.concat("event_type", F.lit(" #"), F.col("user_id").cast("string"))).alias("name")).groupBy("event_type", "name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.short_hash(F.col("text")).alias("hash"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS html_digest, CASE WHEN regexp_matches(url || ', x', '[,\"\\n]') THEN '\"' || replace(url || ', x', '\"', '\"\"') || '\"' ELSE url || ', x' END AS csv FROM pages")
def escapes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("html_digest"), text.escape_csv(F.concat("url", F.lit(", x"))).alias("csv"))


_ORDER_SEV = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END"


def order_issues(spark, sf):
    """Orders as issues of their customer."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.expr(_ORDER_SEV).alias("severity"))


@query(f"SELECT o_orderstatus, count(*) AS total, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low, count(*) FILTER (s = 'info') AS info FROM (SELECT o_orderstatus, {_ORDER_SEV} AS s FROM orders) GROUP BY 1")
def severity_histogram(spark, sf):
    return order_issues(spark, sf).groupBy("o_orderstatus").agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in severity.ORDER))


@query(f"SELECT coalesce(c_custkey, o_custkey) AS custkey, greatest(0, 100 - sum(CASE s WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 WHEN 'info' THEN 1 ELSE 0 END))::BIGINT AS score FROM customer FULL JOIN (SELECT o_custkey, {_ORDER_SEV} AS s FROM orders) ON c_custkey = o_custkey GROUP BY 1")
def file_score(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    o = order_issues(spark, sf).select(F.col("o_custkey").alias("custkey"), "severity")
    return c.join(o, "custkey", "full").groupBy("custkey").agg(severity.score(F.col("severity")).alias("score"))


@query("SELECT event_id, round(count(*) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) / 3600, 9) AS rate FROM events")
def sliding_rate(spark, sf):
    return windows.sliding_rate(table(spark, sf, "events"), "event_type", "ts", 3600).select("event_id", "rate")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(count(*) / 3600, 9) AS rate FROM events GROUP BY ALL")
def windowed_rate(spark, sf):
    return rates.windowed_rate(table(spark, sf, "events"), "ts", "event_type", "1 hour", 3600).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS mean FROM events")
def running_mean(spark, sf):
    return windows.running_mean(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "mean")


@query("SELECT day::VARCHAR AS day, event_type, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM (SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)")
def throughput_lag(spark, sf):
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return e.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id, event_id FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE nxt IS NULL OR nxt - epoch_us(ts) >= 3600000000")
def debounce_events(spark, sf):
    return windows.debounce(table(spark, sf, "events"), "user_id", "ts", 3600).select("user_id", "event_id")


@query("SELECT user_id, min(ts) AS ts, session::BIGINT AS session FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY ALL")
def debounce_leading(spark, sf):
    return windows.debounce_leading(table(spark, sf, "events"), "user_id", "ts", 3600).select("user_id", "ts", "session")


@query("SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY ALL")
def sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT p.event_id, v.view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts AS view_ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.view_ts")
def asof_view_to_action(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("view_ts"))
    return joins.asof(e.filter("event_type = 'purchase'"), views, "user_id", "ts", "view_ts").select("event_id", F.col("asof_value").alias("view_ts"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def keep_last_n(spark, sf):
    return windows.keep_last(table(spark, sf, "events"), 100, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, more FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, greatest(0, count(*) OVER (PARTITION BY l_suppkey) - 50)::BIGINT AS more FROM lineitem) WHERE n <= 50")
def topk_per_group(spark, sf):
    return windows.top_with_rest(table(spark, sf, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 50).select("l_suppkey", "l_orderkey", "l_linenumber", "more")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_types(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("SELECT user_id, event_type, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE b < 20")
def soft_limit(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return windows.soft_limit(e, ["user_id"], ["event_type"], "n", 20)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def resolved_findings(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    still = c.join(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return joins.resolved(c, still)


@query('SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, date_diff(\'day\', DATE \'1990-01-01\', o_orderdate::DATE) AS s FROM orders) a WHERE EXISTS (SELECT 1 FROM (SELECT o_custkey AS k, date_diff(\'day\', DATE \'1990-01-01\', o_orderdate::DATE) AS s FROM orders WHERE o_orderstatus = \'O\') b WHERE k = a.o_custkey AND b.s - 5 <= a.s + 30 AND b.s + 35 >= a.s)')
def interval_overlap(spark, sf):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("start"), (day + 30).alias("end"))
    return joins.overlapping(o, o.filter("o_orderstatus = 'O'"), "o_custkey", 5).select("o_orderkey")


@query("SELECT key, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'modified' END AS status, a.v AS old, b.v AS new FROM (SELECT o_custkey AS key, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS key, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def settings_diff(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("v"))
    return joins.difference(side("F"), side("O"), "key", "v")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM (SELECT user_id, event_id, (epoch_us(ts), event_id) AS ts FROM events) GROUP BY 1")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"))
    return joins.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "seq").select("user_id", "event_id")


@query("SELECT event_id, least(1000 * pow(2, event_id % 8), 30000)::DOUBLE AS delay, (event_id % 3 = 0) AS retryable FROM events")
def backoff_schedule(spark, sf):
    message = F.when(F.col("event_id") % 3 == 0, "HTTP 503 from host").when(F.col("event_id") % 3 == 1, "401 unauthorized").otherwise("validation failed")
    return table(spark, sf, "events").select("event_id", scoring.backoff(F.col("event_id") % 8 + 1).alias("delay"), scoring.retryable(message).alias("retryable"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN value > 50 WHEN 1 THEN value >= 50 WHEN 2 THEN value < 50 WHEN 3 THEN value <= 50 ELSE value = 50 END AS breach FROM events")
def thresholds(spark, sf):
    op = F.element_at(F.array(*map(F.lit, ("gt", "gte", "lt", "lte", "eq"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", scoring.compare(F.col("value"), op, F.lit(50.0)).alias("breach"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, CASE WHEN p_size * 2 >= 80 THEN 'excellent' WHEN p_size * 2 >= 60 THEN 'good' WHEN p_size * 2 >= 40 THEN 'fair' ELSE 'poor' END AS class FROM part")
def titles_and_score_classes(spark, sf):
    snake = F.translate(F.lower("p_type"), " ", "_")
    return table(spark, sf, "part").select("p_partkey", text.title_words(snake).alias("title"), reports.score_class(F.col("p_size") * 2).alias("class"))


# The other families register themselves.
from siltworks import queries_functions, queries_infra, queries_reports, queries_rules, queries_state, queries_tables, queries_views, queries_vulnerabilities  # noqa: E402, F401
