"""Queries on rule tables of any size, on what code says of other code, and on operators with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import custom_rules as C
from siltworks.operators import incremental as I
from siltworks.plans import rules as plans
from siltworks.queries_views import _V
from siltworks.registry import lit, query, table
from siltworks.sources import plugins, reports
from siltworks.streaming import cached, documents

# one rule a customer, k; ``x`` is the same in both dialects
_K = {
    "severity": "CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END",
    "category": "CASE k % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'quality' WHEN 2 THEN 'style' ELSE 'custom' END",
    "language": "CASE k % 3 WHEN 0 THEN '*' WHEN 1 THEN 'python' ELSE 'Go' END",
    "enabled": "k % 7 <> 0",
    "pattern": "CASE k % 6 WHEN 0 THEN '0+' WHEN 1 THEN '[1-9]' WHEN 2 THEN '(bad' WHEN 3 THEN 'CUSTOMER' WHEN 4 THEN 'r#0*' ELSE '' END",
}
_RULES = "SELECT c_custkey AS k, 'rule-' || c_custkey AS id, c_name, " + ", ".join(f"{x} AS {n}" for n, x in _K.items()) + " FROM customer WHERE c_custkey IS NOT NULL"


def many_rules(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey is not null").select(F.col("c_custkey").alias("k"), "c_name").withColumns({n: F.expr(x) for n, x in _K.items()})
    pattern = lambda value, flags: F.struct(F.lit("regex").alias("type"), value.alias("value"), flags.alias("flags"), F.lit(None).cast("boolean").alias("multiline"), F.lit(None).cast("double").alias("confidence"))
    k = F.col("k")
    first = pattern(F.col("pattern"), F.when(k % 6 == 3, F.lit("gi")))
    case = F.struct(
        F.concat(F.lit("case "), k.cast("string")).alias("name"), F.concat("c_name", F.lit("\n"), "c_name").alias("code"), F.lit("python").alias("language"), (k % 2 == 0).alias("shouldMatch"),
        F.when(k % 5 == 0, 2).cast("int").alias("expectedMatches"), F.when(k % 8 == 0, k % 3 + 1).cast("int").alias("expectedLine"),
    )
    return c.select(
        F.concat(F.lit("rule-"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("text").alias("description"), F.lit("1.0.0").alias("version"), "severity", "category",
        F.when(k % 3 == 2, F.array(F.lit("Go"), F.lit("java"))).otherwise(F.array("language")).alias("languages"), F.when(k % 4 == 1, F.array(first, pattern(F.lit("9"), F.lit(None).cast("string")))).otherwise(F.array(first)).alias("patterns"),
        F.struct(F.lit("said").alias("default"), F.lit(None).cast("string").alias("fix"), F.lit(None).cast("map<string,string>").alias("placeholders")).alias("message"), "enabled", F.array(case).alias("testCases"),
        F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("deprecationMessage"), F.lit(None).cast("array<struct<description:string,confidence:double>>").alias("fixes"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("struct<cwe:array<string>,owasp:array<string>>").alias("metadata"), F.col("k").alias("ord"),
    )


@query(f"SELECT id FROM ({_RULES}) WHERE enabled AND category IN ('security', 'quality') AND severity IN ('critical', 'high', 'medium') AND language IN ('*', 'python')")
def rule_selection(spark, sf):
    return C.select(many_rules(spark, sf), categories=("security", "quality"), min_severity="medium", language="Python").select("id")


@query(f"SELECT id, CASE WHEN k % 50 = 0 THEN true WHEN k IN (3, 4, 50) THEN false ELSE enabled END AS enabled FROM ({_RULES}) WHERE k NOT IN (1, 2)")
def rule_changes(spark, sf):
    """Two rules go, three are switched off, and every fiftieth is set anew, enabled."""
    rules = many_rules(spark, sf)
    changed = C.switched(C.removed(rules, ["rule-1", "rule-2"]), ["rule-3", "rule-4", "rule-50"], False)
    return C.added(changed, rules.filter("ord % 50 = 0").withColumn("enabled", F.lit(True))).select("id", "enabled")


_CODE = "c_name || chr(10) || c_name"
_HITS = f"CASE k % 6 WHEN 0 THEN len(regexp_extract_all({_CODE}, '0+')) WHEN 1 THEN len(regexp_extract_all({_CODE}, '[1-9]')) WHEN 3 THEN len(regexp_extract_all({_CODE}, 'CUSTOMER', 0, 'i')) WHEN 4 THEN len(regexp_extract_all({_CODE}, 'r#0*')) ELSE 0 END + CASE WHEN k % 4 = 1 THEN len(regexp_extract_all({_CODE}, '9')) ELSE 0 END"


@query(f"SELECT id, 'case ' || k AS test, CASE WHEN k % 2 = 0 THEN found > 0 AND (k % 5 <> 0 OR found = 2) AND (k % 8 <> 0 OR k % 3 < 2) ELSE found = 0 END AS passed, found FROM (SELECT *, CASE WHEN language <> 'Go' THEN {_HITS} ELSE 0 END::BIGINT AS found FROM ({_RULES}))")
def rule_tests(spark, sf):
    """Each code has two equal lines, so each pattern is in both or in none."""
    return C.run_tests(many_rules(spark, sf))


@query(
    f"WITH r AS ({_RULES}) SELECT 'total' AS what, '' AS name, count(*) AS n FROM r UNION ALL SELECT 'enabled', '', count(*) FROM r WHERE enabled HAVING count(*) > 0 UNION ALL SELECT 'category', category, count(*) FROM r GROUP BY category "
    "UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY severity UNION ALL SELECT 'language', language, count(*) FROM r GROUP BY language UNION ALL SELECT 'language', 'java', count(*) FROM r WHERE language = 'Go' HAVING count(*) > 0"
)
def rule_statistics(spark, sf):
    return C.statistics(many_rules(spark, sf))


@query(f"SELECT array_to_string(list_sort(list(DISTINCT l)), ',') AS languages, (SELECT array_to_string(list_sort(list(DISTINCT category)), ',') FROM ({_RULES})) AS categories FROM (SELECT language AS l FROM ({_RULES}) UNION ALL SELECT 'java' FROM ({_RULES}) WHERE language = 'Go' UNION ALL SELECT 'rust' FROM ({_RULES}) WHERE k % 9 = 0)")
def rule_vocabulary(spark, sf):
    rules = many_rules(spark, sf)
    v = C.vocabulary(C.appended(rules, rules.filter("ord % 9 = 0").withColumn("languages", F.array(F.lit("rust")))))
    return v.select(F.array_join("languages", ",").alias("languages"), F.array_join("categories", ",").alias("categories"))


@query(
    f"WITH r AS ({_RULES}) SELECT 0 AS part, 0::BIGINT AS seq, '{{\"version\":\"1.0.0\",\"exportedAt\":\"2024-01-01T00:00:00Z\",\"rules\":[' AS text UNION ALL SELECT 2, 0, ']}}' UNION ALL "
    "SELECT 1, k, CASE WHEN k > (SELECT min(k) FROM r) THEN ',' ELSE '' END || '{\"id\":\"' || id || '\",\"name\":\"' || c_name || '\",\"description\":\"text\",\"version\":\"1.0.0\",\"severity\":\"' || severity || '\",\"category\":\"' || category || '\",\"languages\":[' "
    "|| CASE WHEN language = 'Go' THEN '\"Go\",\"java\"' ELSE '\"' || language || '\"' END || '],\"patterns\":[{\"type\":\"regex\",\"value\":\"' || pattern || '\"' || CASE WHEN k % 6 = 3 THEN ',\"flags\":\"gi\"' ELSE '' END || '}' || CASE WHEN k % 4 = 1 THEN ',{\"type\":\"regex\",\"value\":\"9\"}' ELSE '' END "
    "|| '],\"message\":{\"default\":\"said\"},\"enabled\":' || enabled || ',\"testCases\":[{\"name\":\"case ' || k || '\",\"code\":\"' || c_name || '\\n' || c_name || '\",\"language\":\"python\",\"shouldMatch\":' || (k % 2 = 0) || CASE WHEN k % 5 = 0 THEN ',\"expectedMatches\":2' ELSE '' END || CASE WHEN k % 8 = 0 THEN ',\"expectedLine\":' || (k % 3 + 1) ELSE '' END "
    "|| '}],\"deprecated\":false}' FROM r"
)
def rule_export(spark, sf):
    """The whole document, row by row."""
    return C.export_rows(many_rules(spark, sf), "2024-01-01T00:00:00Z")


# The built-in rules' categories and priorities, in the order of their numbers.
_BUILT_IN = (
    (1, "injection", 1), (2, "injection", 2), (3, "injection", 1), (4, "injection", 2), (5, "secrets", 1), (6, "injection", 1), (7, "injection", 2), (8, "injection", 2), (9, "cryptography", 3),
    (10, "injection", 1), (11, "injection", 2), (12, "cryptography", 3), (13, "injection", 3), (14, "authentication", 2), (15, "configuration", 3),
)


@query(
    "SELECT o_orderkey, 'SEC' || lpad(n::VARCHAR, 3, '0') AS rule_id, (row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, n) - 1)::INT AS place FROM (SELECT * FROM orders WHERE o_orderkey % 10 = 0) o, (VALUES "
    + ", ".join(f"({n}, {lit(c)}, {p})" for n, c, p in _BUILT_IN)
    + ") AS r(n, category, priority) WHERE n <> o_orderkey % 16 + 1 AND n <> o_custkey % 9 + 1 AND (o_orderkey % 3 > 0 OR category IN ('secrets', 'cryptography'))"
)
def rule_priorities(spark, sf):
    """The rules that each tenth order asks for: enabled, not switched off by it, in its categories, by priority."""
    rows = [(r.id, r.category, r.enabled, r.priority) for r in plans.BUILT_IN]
    rules = spark.createDataFrame(rows, "id string, category string, enabled boolean, priority int")
    number = lambda c: F.concat(F.lit("SEC"), F.lpad((c + 1).cast("string"), 3, "0"))
    asked = table(spark, sf, "orders").filter("o_orderkey % 10 = 0").select("o_orderkey", F.array(number(F.col("o_orderkey") % 16), number(F.col("o_custkey") % 9)).alias("disabled"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("secrets"), F.lit("cryptography"))).alias("categories"))
    return C.applicable(asked, rules, ["o_orderkey"])


_FORMS = (("sarif", "sarif", "application/json"), ("html", "html", "text/html"), ("json", "json", "application/json"), ("markdown", "md", "text/markdown"), ("csv", "csv", "text/csv"), ("junit", "xml", "application/xml"),
          ("sonarqube", "json", "application/json"), ("checkstyle", "xml", "application/xml"), ("codeclimate", "json", "application/json"), ("other", "txt", "text/plain"))
_FORM = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(_FORMS)) + " END"


@query("SELECT o_orderkey, form, extension, media_type FROM orders, (VALUES " + ", ".join(f"({i}, {lit(a)}, {lit(b)}, {lit(c)})" for i, (a, b, c) in enumerate(_FORMS)) + ") AS f(i, form, extension, media_type) WHERE o_orderkey % 10 = i")
def report_formats(spark, sf):
    """Each order's report: how its file ends, and what it is."""
    rows = table(spark, sf, "orders").filter("o_orderkey is not null").select("o_orderkey", F.expr(_FORM).alias("form"))
    return rows.withColumns({"extension": reports.extension_of(F.col("form")), "media_type": reports.media_type_of(F.col("form"))})


_LANG = "CASE c_custkey % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'java' ELSE 'odd' END"
_SOURCE = (
    "CASE c_custkey % 5 WHEN 2 THEN concat('from a.b', CAST(c_custkey % 3 AS STRING), ' import c\\nimport os\\n__all__ = [x', CAST(c_custkey % 4 AS STRING), ', y]') WHEN 3 THEN concat('import p.Q', CAST(c_custkey % 3 AS STRING), ';') WHEN 4 THEN 'import x' "
    "ELSE concat('import { x } from ''lib', CAST(c_custkey % 3 AS STRING), '''\\nconst z = require(''y', CAST(c_custkey % 4 AS STRING), ''')\\nexport { a', CAST(c_custkey % 4 AS STRING), ', b }\\nmodule.exports = one\\nexport enum E {}') END"
)


@query(
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN 'a.b' || (c_custkey % 3) || ',c,os' WHEN 3 THEN 'p.Q' || (c_custkey % 3) WHEN 4 THEN '' ELSE 'lib' || (c_custkey % 3) || ',y' || (c_custkey % 4) END AS dependencies, "
    "CASE c_custkey % 5 WHEN 0 THEN 'a' || (c_custkey % 4) || ',b,one' WHEN 1 THEN 'E,a' || (c_custkey % 4) || ',b' WHEN 2 THEN 'x' || (c_custkey % 4) || ',y' ELSE '' END AS exports FROM customer WHERE c_custkey IS NOT NULL"
)
def code_relations(spark, sf):
    """What each customer's file depends on, and what it gives away."""
    df = table(spark, sf, "customer").filter("c_custkey is not null").select("c_custkey", F.expr(_LANG).alias("language"), F.replace(F.expr(_SOURCE), F.lit("\\n"), F.lit("\n")).alias("content"))
    return df.select("c_custkey", F.array_join(I.dependencies(F.col("content"), F.col("language")), ",").alias("dependencies"), F.array_join(I.exports(F.col("content"), F.col("language")), ",").alias("exports"))


# each event is a version of its user's document; sixteen caches of five documents each
_DOCS = "SELECT event_id, user_id, user_id % 16 AS bucket, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 ELSE 0 END AS c FROM events"


@query(
    f"WITH v AS ({_DOCS}), p AS (SELECT *, lag(event_id) OVER w AS before, lag(c) OVER w AS old FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), n AS (SELECT p.event_id, count(DISTINCT x.user_id) AS others FROM p JOIN v x ON x.bucket = p.bucket AND x.event_id > p.before AND x.event_id < p.event_id GROUP BY 1) "
    "SELECT event_id, change, CASE change WHEN 'same' THEN 0 ELSE 4 END::BIGINT AS affected, CASE change WHEN 'same' THEN 4 ELSE 0 END::BIGINT AS unchanged FROM (SELECT p.event_id, CASE WHEN before IS NULL OR coalesce(others, 0) >= 5 THEN 'new' WHEN old = c THEN 'same' ELSE 'changed' END AS change FROM p LEFT JOIN n USING (event_id))"
)
def document_states(spark, sf):
    """What each version of a document gives where a cache remembers the five documents used last."""
    e = table(spark, sf, "events").filter("event_id is not null and user_id is not null")
    content = F.when(F.col("event_type").isin("click", "error"), _V[1]).otherwise(_V[0])
    v = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("uri"), F.col("event_id").alias("version"), F.lit("python").alias("language"), content.alias("content"), (F.col("user_id") % 16).alias("cache"))
    count = lambda status: F.size(F.filter("scopes", lambda s: s["status"] == status)).cast("long").alias(status)
    return documents.analyze(v, 5, F.col("cache")).select(F.col("seq").alias("event_id"), "change", count("affected"), count("unchanged"))


_OPS = {
    "op": "CASE event_type WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END",
    "ttl": "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 9000000 ELSE 36000000 END",
    "priority": "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END",
    "tier": "CASE event_id % 3 WHEN 0 THEN 'persistent' ELSE 'memory' END",
}


@query(
    f"""WITH RECURSIVE o AS (SELECT *, CASE WHEN op <> 'set' THEN NULL WHEN coalesce(ttl, 1800000) > 0 THEN at + coalesce(ttl, 1800000) ELSE -1 END AS ends FROM (SELECT event_id, user_id AS k, epoch_ms(ts) AS at, {', '.join(f'{x} AS {n}' for n, x in _OPS.items())}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)),
s AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS op, NULL::BIGINT AS at, NULL::BIGINT AS m, NULL::BIGINT AS p, NULL::VARCHAR AS tier, NULL::VARCHAR AS result FROM o WHERE n = 1
UNION ALL SELECT k, n, event_id, op, at, CASE op WHEN 'delete' THEN NULL WHEN 'set' THEN CASE WHEN to_memory THEN ends ELSE m END ELSE CASE WHEN m_serves THEN m WHEN p_serves THEN p END END, CASE op WHEN 'delete' THEN NULL WHEN 'set' THEN CASE WHEN to_persistent THEN ends ELSE p END ELSE CASE WHEN m_serves OR p_serves THEN p END END,
CASE WHEN op = 'get' THEN CASE WHEN m_serves THEN 'memory' WHEN p_serves THEN 'persistent' END END, CASE WHEN op = 'get' THEN CASE WHEN NOT m_serves AND NOT p_serves THEN 'miss' WHEN CASE WHEN m_serves THEN m ELSE p END = -1 OR at <= CASE WHEN m_serves THEN m ELSE p END THEN 'hit' ELSE 'stale' END END
FROM (SELECT o.k, o.n, o.event_id, o.op, o.at, o.ends, s.m, s.p, coalesce(s.m = -1 OR o.at - s.m <= 300000, false) AS m_serves, coalesce(s.p = -1 OR o.at - s.p <= 300000, false) AS p_serves, o.tier = 'memory' OR o.priority >= 3 AS to_memory, o.tier = 'persistent' OR o.priority >= 2 AS to_persistent FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1))
SELECT event_id, tier, result, coalesce(tier = 'persistent', false) AS promoted FROM s WHERE op = 'get'""".replace(" at ", ' "at" ').replace(" at,", ' "at",').replace(".at ", '."at" ').replace(".at,", '."at",').replace(" at)", ' "at")')
)
def cache_replay(spark, sf):
    """What each view and click finds in its user's cache, which purchases and signups fill and errors empty."""
    e = table(spark, sf, "events").filter("event_id is not null and ts is not null")
    ops = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), *(F.expr(x).alias(n) for n, x in _OPS.items()))
    return cached.replay(ops).select(F.col("seq").alias("event_id"), "tier", "result", "promoted")


# a nation's customers have one manifest each, in folders of four classes
_MANIFESTS = (
    "SELECT c_nationkey AS owner, (c_custkey % 4)::INT AS place, '/f' || (c_custkey % 4) || '/p' || c_custkey || '/plugin.json' AS path, CASE WHEN c_custkey % 6 > 0 THEN 'plugin-' || (c_custkey % 23) END AS id, CASE c_custkey % 8 WHEN 0 THEN '' ELSE c_name END AS name, c_custkey % 9 <> 3 AS whole, "
    "CASE WHEN c_custkey % 5 = 1 THEN 'Shown ' || c_custkey END AS shown, c_custkey % 3 AS n FROM customer WHERE c_custkey IS NOT NULL"
)


@query(
    f"WITH m AS (SELECT *, whole AND id IS NOT NULL AND name <> '' AS valid FROM ({_MANIFESTS})), f AS (SELECT *, valid AND row_number() OVER (PARTITION BY owner, valid, id ORDER BY place, path) = 1 AS first FROM m), c AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY owner ORDER BY place, path ROWS UNBOUNDED PRECEDING) AS upto FROM f) "
    "SELECT owner, place, path, CASE WHEN whole THEN id END AS id, CASE WHEN whole THEN coalesce(shown, name) END AS name, CASE WHEN NOT valid THEN 'invalid' WHEN NOT first THEN 'repeated' WHEN upto > 3 THEN 'refused' ELSE 'enabled' END AS status, CASE WHEN whole THEN n ELSE 0 END::INT AS rules FROM c"
)
def plugin_manifests(spark, sf):
    """What becomes of each manifest where three plugins are taken for each owner."""
    c = table(spark, sf, "customer").filter("c_custkey is not null")
    k = F.col("c_custkey")
    rule = F.concat(F.lit('{"id":"r'), k.cast("string"), F.lit('","name":"a rule"}'))
    content = F.concat(
        F.lit("{"), F.when(k % 6 > 0, F.concat(F.lit('"id":"plugin-'), (k % 23).cast("string"), F.lit('",'))).otherwise(""), F.lit('"name":"'), F.when(k % 8 > 0, F.col("c_name")).otherwise(""), F.lit('","version":"1.0.0"'),
        F.when(k % 5 == 1, F.concat(F.lit(',"displayName":"Shown '), k.cast("string"), F.lit('"'))).otherwise(""), F.lit(',"contributes":{"rules":['), F.array_join(F.array_repeat(rule, (k % 3).cast("int")), ","), F.when(k % 9 == 3, "]}").otherwise("]}}"),
    )
    files = c.select(F.col("c_nationkey").alias("owner"), (k % 4).cast("int").alias("place"), F.concat(F.lit("/f"), (k % 4).cast("string"), F.lit("/p"), k.cast("string"), F.lit("/plugin.json")).alias("path"), content.alias("content"))
    return plugins.manifests(files, ["owner"], 3).select("owner", "place", "path", "id", "name", "status", F.size("rules").alias("rules"))
