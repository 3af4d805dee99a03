"""Queries on views, feedback, dependencies, plugins and document versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import extension as X
from siltworks.operators import incremental as I
from siltworks.operators import views as V
from siltworks.registry import query, table

_SEV = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_ISSUES = f"SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 > 0 THEN 'f' || (o_custkey % 400) END AS path, {_SEV} AS severity, 'T' || (o_orderkey % 6) AS type FROM orders"


def issues(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS seq", "CASE WHEN o_orderkey % 11 > 0 THEN concat('f', CAST(o_custkey % 400 AS STRING)) END AS path", f"{_SEV} AS severity", "concat('T', CAST(o_orderkey % 6 AS STRING)) AS type")


_PENALTY = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 WHEN 'info' THEN 1 ELSE 0 END"


@query(f"SELECT coalesce(f.path, i.path) AS path, count(severity) AS n, greatest(0, 100 - coalesce(sum({_PENALTY}), 0))::BIGINT AS score FROM (SELECT 'f' || n AS path FROM generate_series(390, 420) AS g(n)) f FULL JOIN (SELECT * FROM ({_ISSUES}) WHERE path IS NOT NULL) i ON f.path = i.path GROUP BY 1")
def file_results(spark, sf):
    files = spark.range(390, 421).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return V.files_by_count(V.file_results(files, issues(spark, sf)))


@query(f"SELECT type, path, count(*) AS n, min(seq) AS first, sum(count(*)) OVER (PARTITION BY type)::BIGINT AS outer_n, count(*) OVER (PARTITION BY type) AS inner_n FROM ({_ISSUES}) GROUP BY type, path")
def nested_groups(spark, sf):
    return V.nested_groups(issues(spark, sf).withColumn("path", F.coalesce("path", F.lit("none"))), "type", "path").withColumn("path", F.nullif("path", F.lit("none")))


@query(f"SELECT path, count(*) AS n, min(seq) AS first FROM ({_ISSUES}) GROUP BY 1")
def finding_groups(spark, sf):
    return V.grouped(issues(spark, sf), "path")


@query(f"SELECT severity, count(*) AS n, {_RANK}::INT AS rank FROM ({_ISSUES}) GROUP BY 1")
def severity_groups(spark, sf):
    return V.severity_groups(issues(spark, sf))


@query(f"SELECT type, upper(severity[1]) || severity[2:] AS label, count(*) AS n FROM ({_ISSUES}) WHERE severity <> 'info' GROUP BY ALL")
def summary_rows(spark, sf):
    return V.summary_rows(issues(spark, sf), "type")


_DEPS = "SELECT p_partkey, p_name AS name, ['direct', 'dev', 'peer', 'optional', 'transitive', 'odd'][p_partkey % 6 + 1] AS type, p_brand AS project, CASE WHEN p_partkey % 9 > 0 THEN 'L' || (p_partkey % 30) END AS license FROM part"


def parts(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("direct", "dev", "peer", "optional", "transitive", "odd"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), kind.alias("type"), F.col("p_brand").alias("project"), F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("L"), (F.col("p_partkey") % 30).cast("string"))).alias("license"))


@query(f"SELECT project, name, type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY list_position(['direct', 'dev', 'peer', 'optional', 'transitive', 'odd'], type), lower(name), name) AS n FROM ({_DEPS})) WHERE n <= 3")
def dependency_list(spark, sf):
    return V.dependencies(parts(spark, sf), ["project"], 3).select("project", "name", "type")


_RISKS = "(VALUES ('L1', 'high'), ('L2', 'medium'), ('L3', 'low'), ('L99', 'high')) AS r(license, risk)"


def risks(spark):
    return spark.createDataFrame([("L1", "high"), ("L2", "medium"), ("L3", "low"), ("L99", "high")], "license string, risk string")


@query(f"SELECT license, risk, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END::INT AS place FROM (SELECT * FROM {_RISKS} UNION ALL SELECT DISTINCT license, 'unknown' FROM ({_DEPS}) WHERE license IS NOT NULL AND license NOT IN ('L1', 'L2', 'L3'))")
def license_list(spark, sf):
    return V.licenses(risks(spark), parts(spark, sf))


@query(f"SELECT project, count(*) FILTER (r.risk = 'high') = 0 AS compliant FROM ({_DEPS}) d LEFT JOIN {_RISKS} USING (license) GROUP BY 1")
def license_compliance(spark, sf):
    return V.compliant(parts(spark, sf).join(F.broadcast(risks(spark)), "license", "left"), "project")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'specific' ELSE 'basic' END AS kind, c_name AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def diagnostic_actions(spark, sf):
    vulns = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("title"))
    return V.with_vulnerability(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("code")), vulns).select("o_orderkey", "kind", "title")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 4 AND l_returnflag = 'R' AND NOT coalesce(l_linestatus = 'F' AND l_orderkey % 2 = 0, false)")
def auto_fixes(spark, sf):
    fixes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") < 4).alias("fixable"), F.when(F.col("l_returnflag") == "R", "auto_apply").otherwise("review").alias("confidence"), ((F.col("l_linestatus") == "F") & (F.col("l_orderkey") % 2 == 0)).alias("breaking"), F.col("l_linenumber").alias("start_line"))
    return V.auto_fixes(fixes).select("l_orderkey", "l_linenumber")


_CVES = "SELECT p_partkey AS seq, 'CWE-' || (p_partkey % 50) AS cwe, p_type AS type, p_name AS title, ['python', 'java'][p_partkey % 2 + 1] AS language FROM part"


def cves(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS seq", "concat('CWE-', CAST(p_partkey % 50 AS STRING)) AS cwe", "p_type AS type", "p_name AS title", "CASE p_partkey % 2 WHEN 0 THEN 'python' ELSE 'java' END AS language", "CASE p_partkey % 3 WHEN 0 THEN ' eval(x) ' ELSE 'open(y)' END AS vulnerable_code")


@query(f"SELECT seq, 'search' AS way FROM ({_CVES}) WHERE contains(lower(title), 'a') OR contains(lower(type), 'a') UNION ALL SELECT seq, 'cwe' FROM ({_CVES}) WHERE cwe = 'CWE-7' UNION ALL SELECT seq, 'code' FROM ({_CVES}) WHERE seq % 3 = 0 AND language = 'java' UNION ALL (SELECT min(seq), 'fix' FROM ({_CVES}) WHERE cwe = 'CWE-7' AND language = 'java')")
def cve_lookups(spark, sf):
    c = cves(spark, sf)
    way = lambda df, name: df.select("seq", F.lit(name).alias("way"))
    out = way(V.cve_lookup(c, query="A"), "search").unionByName(way(V.cve_lookup(c, cwe="cwe-7"), "cwe"))
    return out.unionByName(way(V.cve_lookup(c, code="y = eval(x)", language="Java"), "code")).unionByName(way(V.first_fix(c, "CWE-7", "java"), "fix"))


@query("SELECT p.event_id, (epoch_us(p.ts) - epoch_us(v.ts)) // 1000 AS time_to_action FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def time_to_action(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return V.with_view_time(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'").select("user_id", "ts"), "user_id", "ts").select("event_id", "time_to_action")


_ACTION = "CASE event_type WHEN 'purchase' THEN 'ACCEPTED' WHEN 'click' THEN 'FIXED' WHEN 'error' THEN 'REJECTED' ELSE 'VIEWED' END"
_FEEDBACK = f"SELECT {_ACTION} AS action, 'T' || (user_id % 12) AS type, CASE WHEN event_id % 3 > 0 THEN 'L' || (user_id % 4) END AS language, ['low', 'high'][event_id % 2 + 1] AS severity FROM events"


def feedback(spark, sf):
    return table(spark, sf, "events").select(F.expr(_ACTION).alias("action"), F.concat(F.lit("T"), (F.col("user_id") % 12).cast("string")).alias("type"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string"))).alias("language"), F.when(F.col("event_id") % 2 == 0, "low").otherwise("high").alias("severity"))


_RATES = "count(*) AS total, count(*) FILTER (action IN ('ACCEPTED', 'FIXED')) AS accepted, count(*) FILTER (action = 'REJECTED') AS rejected, round(coalesce(count(*) FILTER (action IN ('ACCEPTED', 'FIXED')) / nullif(count(*) FILTER (action IN ('ACCEPTED', 'FIXED', 'REJECTED')), 0), 0), 6) AS rate"
_ACCURACY = " UNION ALL ".join([f"SELECT 'all' AS dimension, '' AS value, {_RATES} FROM ({_FEEDBACK})"] + [f"SELECT '{d}', {d}, {_RATES} FROM ({_FEEDBACK}) WHERE {d} IS NOT NULL GROUP BY {d}" for d in ("type", "language", "severity")])


@query(_ACCURACY)
def feedback_accuracy(spark, sf):
    return V.accuracy(feedback(spark, sf), "type", "language", "severity")


@query(f"SELECT value, total, floor(rate * 100 + 0.5)::BIGINT || '%' AS percent FROM ({_ACCURACY}) WHERE dimension = 'type' ORDER BY total DESC, value LIMIT 10")
def feedback_top_types(spark, sf):
    return V.top_types(V.accuracy(feedback(spark, sf), "type").filter("dimension = 'type'"))


@query("SELECT event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 5 THEN (event_id % 9)::INT END AS rating FROM events")
def feedback_ratings(spark, sf):
    return table(spark, sf, "events").select("event_id", V.rating(F.col("event_type"), F.col("event_id") % 9).alias("rating"))


_PLUGINS = "SELECT c_custkey AS id, c_mktsegment AS owner, ['enabled', 'disabled', 'error'][c_custkey % 3 + 1] AS status, CASE WHEN c_custkey % 4 > 0 THEN ['analyzer', 'rule', 'theme'][c_custkey % 4] END AS type FROM customer"
_STATES = "CASE WHEN s.enabled THEN 'enabled' WHEN NOT s.enabled THEN 'disabled' ELSE status END"
_SAVED = "SELECT o_custkey AS id, min(o_orderkey) % 2 = 0 AS enabled FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1"


def plugins(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS owner", "CASE c_custkey % 3 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' ELSE 'error' END AS status", "CASE c_custkey % 4 WHEN 1 THEN 'analyzer' WHEN 2 THEN 'rule' WHEN 3 THEN 'theme' END AS type")


def saved(spark, sf):
    return table(spark, sf, "orders").filter("o_custkey % 5 = 0").groupBy(F.col("o_custkey").alias("id")).agg((F.min("o_orderkey") % 2 == 0).alias("enabled"))


@query(f"SELECT owner, count(*) AS total, count(*) FILTER (st = 'enabled') AS enabled, count(*) FILTER (st = 'disabled') AS disabled, count(*) FILTER (st = 'error') AS error, count(*) FILTER (type IS NULL) AS unknown_type FROM (SELECT p.*, {_STATES} AS st FROM ({_PLUGINS}) p LEFT JOIN ({_SAVED}) s USING (id)) GROUP BY 1")
def plugin_statistics(spark, sf):
    return V.plugin_statistics(V.restored(plugins(spark, sf), saved(spark, sf)), "owner")


@query("SELECT owner, id, CASE WHEN is_dir THEN 'plugin' ELSE 'rules' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner, id ORDER BY seq) AS n FROM (SELECT o_custkey % 20 AS owner, o_orderkey % 200 AS id, o_orderkey AS seq, o_orderkey % 3 = 0 AS is_dir, o_orderkey % 2 = 0 AS has_manifest FROM orders) WHERE is_dir AND has_manifest OR NOT is_dir AND seq % 4 = 1) WHERE n = 1) WHERE place <= 50")
def plugin_discovery(spark, sf):
    found = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("owner"), (F.col("o_orderkey") % 200).alias("id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 == 0).alias("is_dir"), (F.col("o_orderkey") % 2 == 0).alias("has_manifest"), F.when(F.col("o_orderkey") % 4 == 1, "a.json").otherwise("a.txt").alias("path"))
    return V.discovered(found, ["owner"]).select("owner", "id", "kind")


@query("SELECT conv_id::VARCHAR AS uri, 'turn' AS name, 'LONG' AS rule_id, 'low' AS severity, 'long turn' AS message, length(text)::BIGINT AS line FROM conversations WHERE role = 'user' AND length(text) > 80")
def own_analyzer(spark, sf):
    r = X.Registry()
    r.analyzer("user", lambda text, name: [("LONG", "low", f"long {name}", len(text))] if text and len(text) > 80 else [])
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("uri"), F.lit("turn").alias("name"), F.col("role").alias("language"), "text")
    return r.analyze(c)


@query("SELECT event_id, value * 2 AS double_value FROM events")
def own_executor(spark, sf):
    r = X.Registry()
    r.executor("double", lambda pdf: pdf.assign(double_value=pdf["value"] * 2)[["event_id", "double_value"]])
    return r.execute("double", table(spark, sf, "events").select("event_id", "value"), "event_id long, double_value double")


# document versions: each customer has three versions of a file
_V = (
    "import os\nfrom a.b import c\n\nclass Box:\n    def open(self):\n        return 1\n\n    def close(self):\n        return 2\n\ndef main():\n    pass",
    "import os\nfrom a.b import c\n\nclass Box:\n    def open(self):\n        return 1\n\n    def close(self):\n        return 3\n\ndef main():\n    pass",
    "import { x } from 'lib'\nexport function one() {\n  return 1\n}\nexport class Two {\n  go() {}\n}\nmodule.exports = one",
)


def versions(spark, sf):
    n = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uri"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"), (F.col("c_custkey") % 2).alias("b"))
    python = F.when(F.col("version") == 1, _V[0]).when(F.col("version") == 2, _V[1]).otherwise(_V[1])
    return n.select("uri", "version", F.when(F.col("b") == 0, "python").otherwise("javascript").alias("language"), F.when(F.col("b") == 0, python).otherwise(F.lit(_V[2])).alias("content"))


_PY = [("function", "open", 4, 6), ("function", "close", 7, 9), ("class", "Box", 3, 9), ("function", "main", 10, 11)]
_JS = [("function", "one", 1, 3), ("class", "Two", 4, 6)]


def _values(rows):
    return "(VALUES " + ", ".join(f"({i}, '{k}', '{n}', {a}, {b})" for i, (k, n, a, b) in enumerate(rows)) + ") AS t(seq, type, name, start_line, end_line)"


@query(f"SELECT c_custkey::VARCHAR AS uri, v AS version, t.* FROM customer, (VALUES (1), (2), (3)) AS n(v), {_values(_PY)} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, v, t.* FROM customer, (VALUES (1), (2), (3)) AS n(v), {_values(_JS)} WHERE c_custkey % 2 = 1")
def version_scopes(spark, sf):
    return I.scopes(versions(spark, sf)).select("uri", "version", "seq", "type", "name", "start_line", "end_line")


@query("SELECT c_custkey::VARCHAR AS uri, 2 AS version, 'replace' AS type, 8 AS start_line, 8 AS end_line, '        return 3' AS content, '        return 2' AS previous FROM customer WHERE c_custkey % 2 = 0")
def version_changes(spark, sf):
    return I.changes(versions(spark, sf))


@query(f"SELECT c_custkey::VARCHAR AS uri, v AS version, name, CASE WHEN v < 3 THEN 'affected' ELSE 'unchanged' END AS status FROM customer, (VALUES (1), (2), (3)) AS n(v), {_values(_PY)} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, v, name, CASE WHEN v = 1 THEN 'affected' ELSE 'unchanged' END FROM customer, (VALUES (1), (2), (3)) AS n(v), {_values(_JS)} WHERE c_custkey % 2 = 1")
def affected_scopes(spark, sf):
    return I.affected(versions(spark, sf)).select("uri", "version", "name", "status")


@query("SELECT c_custkey::VARCHAR AS uri, v AS version, CASE WHEN c_custkey % 2 = 0 AND v < 3 THEN 15 WHEN c_custkey % 2 = 1 AND v = 1 THEN 6 ELSE 0 END::BIGINT AS analyzed, CASE WHEN c_custkey % 2 = 0 THEN 12 ELSE 8 END - CASE WHEN c_custkey % 2 = 0 AND v < 3 THEN 15 WHEN c_custkey % 2 = 1 AND v = 1 THEN 6 ELSE 0 END::BIGINT AS skipped, CASE WHEN c_custkey % 2 = 0 AND v < 3 THEN 125 WHEN c_custkey % 2 = 1 AND v = 1 THEN 75 ELSE 0 END::DOUBLE AS percent FROM customer, (VALUES (1), (2), (3)) AS n(v)")
def analysis_coverage(spark, sf):
    v = versions(spark, sf)
    return I.coverage(I.affected(v), v)


@query("SELECT c_custkey::VARCHAR AS uri, v AS version, 'one' AS name, 'old finding' AS finding FROM customer, (VALUES (2), (3)) AS n(v) WHERE c_custkey % 2 = 1")
def carried_findings(spark, sf):
    v = versions(spark, sf)
    old = v.filter("language = 'javascript'").select("uri", "version", F.lit("one").alias("name"), F.lit(1).alias("start_line"), F.lit("old finding").alias("finding"))
    return I.carried_over(I.affected(v), old, v).select("uri", "version", "name", "finding")


# a scope of a line of an order: unchanged unless it was returned; findings are those of its shipped lines
_STATUS = "SELECT l_orderkey AS uri, l_linenumber AS version, 'n' || (l_suppkey % 2) AS name, l_partkey % 2 AS start_line, CASE WHEN l_returnflag = 'R' THEN 'affected' ELSE 'unchanged' END AS status FROM lineitem"


@query(
    f"WITH s AS ({_STATUS} UNION ALL SELECT uri, version, 'n0', 0, 'unchanged' FROM ({_STATUS})), f AS (SELECT *, 'F' || (version % 3) AS finding FROM ({_STATUS}) WHERE version < 4), u AS (SELECT DISTINCT uri, version, name, start_line FROM s WHERE status = 'unchanged') "
    "SELECT DISTINCT uri, name, start_line, finding, version FROM (SELECT f.uri, f.name, f.start_line, f.finding, f.version AS since, u.version FROM f JOIN u ON f.uri = u.uri AND f.name = u.name AND f.start_line = u.start_line AND u.version > f.version "
    "JOIN s x ON x.uri = f.uri AND x.version > f.version AND x.version <= u.version LEFT JOIN u w ON w.uri = f.uri AND w.name = f.name AND w.start_line = f.start_line AND w.version = x.version GROUP BY ALL HAVING count(DISTINCT x.version) = count(DISTINCT w.version))"
)
def findings_through_versions(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_orderkey is not null").select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("version"), F.concat(F.lit("n"), (F.col("l_suppkey") % 2).cast("string")).alias("name"), (F.col("l_partkey") % 2).alias("start_line"), F.when(F.col("l_returnflag") == "R", "affected").otherwise("unchanged").alias("status"))
    also = rows.select("uri", "version", F.lit("n0").alias("name"), F.lit(0).cast("long").alias("start_line"), F.lit("unchanged").alias("status"))
    found = rows.filter("version < 4").withColumn("finding", F.concat(F.lit("F"), (F.col("version") % 3).cast("string"))).drop("status")
    return I.carried_over(rows.unionByName(also), found, rows)


# a supplier's list of regions, in the order of orders; a region begins with the line number and is as long as the remainder
_LIST = "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag AS type, l_orderkey // 40 AS s, l_orderkey // 40 + l_partkey % 90 AS e, 'c' || l_linenumber AS content, nullif(l_linestatus, 'F') AS previous FROM lineitem"


def _neighbours(source: str) -> str:
    """The regions one after the other, as a fold over each list: each row looks at the last region made so far."""
    return f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM ({source})),
r AS (SELECT l_suppkey, k, 1 AS region, type, s AS start_line, e AS end_line, 1 AS n, content, previous FROM l WHERE k = 1
UNION ALL SELECT l_suppkey, k, CASE WHEN j THEN region ELSE region + 1 END, type, CASE WHEN j THEN start_line ELSE s END, CASE WHEN j THEN greatest(end_line, e) ELSE e END, CASE WHEN j THEN n + 1 ELSE 1 END,
CASE WHEN j THEN before || chr(10) || content ELSE content END, CASE WHEN NOT j THEN previous WHEN old <> '' THEN old || chr(10) || coalesce(previous, '') ELSE previous END
FROM (SELECT l.*, r.region, r.start_line, r.end_line, r.n, r.content AS before, r.previous AS old, l.s <= r.end_line + 1 AND l.type = r.type AS j FROM r JOIN l ON l.l_suppkey = r.l_suppkey AND l.k = r.k + 1))
SELECT l_suppkey, type, start_line, end_line, n, content, previous FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, region ORDER BY k DESC) AS last FROM r) WHERE last = 1"""


@query(_neighbours(_LIST))
def merged_changes(spark, sf):
    x = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_returnflag").alias("type"), F.expr("l_orderkey div 40").alias("start_line"), F.expr("l_orderkey div 40 + l_partkey % 90").alias("end_line"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("content"), F.expr("nullif(l_linestatus, 'F')").alias("previous"))
    return I.merged(x, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
