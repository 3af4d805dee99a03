"""Queries on rule tables: validation, selection, matching, tests, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import custom_rules as C
from siltworks.operators import match
from siltworks.oracles import positions
from siltworks.registry import lit, query, table

#: id, name, severity, category, languages, (regex, flags), message, case: code, language, should match, matches, line
_RULES = (
    ("no-var", "No var", "low", "style", ("javascript",), ((r"\bvar\s+(\w+)", "g"),), "use let for {{$1}}, not {{$0}} in {{where}}", ("var a = 1", "javascript", True, 1, 1)),
    ("long-run", "Long run", "medium", "quality", ("*",), ((r"([a-z])\1\1", "gi"), (r"x+\ny", "")), "{{$1}} thrice", ("aaa\nBBB", "python", True, 2, 2)),
    ("the-word", "The word", "info", "custom", ("*",), ((r"\bthe (\w+)", "i"),), "the {{$1}}; {{$3}}", ("no match here", "go", False, None, None)),
    ("url-link", "A link", "high", "security", ("html", "*"), ((r"href=\"([^\"]*)\"", ""),), "link to {{$1}}", ("href=\"x\"", "html", True, 2, None)),
    ("bad-regex", "Bad regex", "critical", "security", ("python",), ((r"(unclosed", ""),), "never", ("unclosed", "python", True, None, None)),
)


def rule_table(spark, only=None):
    rows = []
    for i, (rid, name, sev, cat, langs, patterns, message, case) in enumerate(_RULES):
        if only is None or rid in only:
            rows.append((rid, name, f"describes {name}", "1.0.0", sev, cat, list(langs), [("regex", r, f, None, 0.9 if i % 2 else None) for r, f in patterns], (message, "change it", {"where": "code"}), rid != "the-word", [(f"case {i}", *case)], False, None, [("weak", 0.5), ("strong", 0.7 + i / 100)], ["t"], (["CWE-1"], None) if i % 2 else None, i))
    return spark.createDataFrame(rows, C.SCHEMA + ", ord int")


# rules of many shapes, one a customer; ``x`` in both dialects
_R = {
    "id": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '-bad' WHEN 3 THEN 'x' ELSE concat('rule-', CAST(c_custkey % 40 AS STRING)) END",
    "name": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ab' WHEN 2 THEN repeat('n', 101) ELSE c_name END",
    "version": "CASE c_custkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '1.0.0-x' ELSE '1.2.3' END",
    "severity": "CASE c_custkey % 3 WHEN 0 THEN 'awful' WHEN 1 THEN 'high' END",
    "category": "CASE c_custkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'security' END",
    "ptype": "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'taint' WHEN 2 THEN 'ast' ELSE 'regex' END",
    "pvalue": "CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN '(a' ELSE 'a+' END",
    "message": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'said' END",
}


def shaped_rules(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 11).cast("string").alias("pack"), *(F.expr(x).alias(n) for n, x in _R.items()))
    empty = lambda t: F.array().cast(f"array<{t}>")
    return c.select(
        "pack", "ord", "id", "name", F.lit("text").alias("description"), "version", "severity", "category", F.when(F.col("ord") % 2 == 0, F.array(F.lit("*"))).alias("languages"),
        F.when(F.col("ord") % 10 != 3, F.array(F.struct(F.col("ptype").alias("type"), F.col("pvalue").alias("value"), F.lit(None).cast("string").alias("flags"), F.lit(None).cast("boolean").alias("multiline"), F.lit(None).cast("double").alias("confidence")))).otherwise(empty(C._PATTERN)).alias("patterns"),
        F.when(F.col("ord") % 6 != 0, F.struct(F.col("message").alias("default"), F.lit(None).cast("string").alias("fix"), F.lit(None).cast("map<string,string>").alias("placeholders"))).alias("message"),
        F.lit(True).alias("enabled"), F.when(F.col("ord") % 4 == 0, empty(C._TEST)).alias("testCases"), (F.col("ord") % 3 == 0).alias("deprecated"), F.when(F.col("ord") % 2 == 0, "why").alias("deprecationMessage"),
        F.lit(None).cast("array<struct<description:string,confidence:double>>").alias("fixes"), F.lit(None).cast("array<string>").alias("tags"), F.when(F.col("ord") % 5 == 0, F.struct(F.array(F.lit("CWE-1")).alias("cwe"), F.lit(None).cast("array<string>").alias("owasp"))).alias("metadata"),
    )


_SHAPED = "SELECT c_custkey AS ord, (c_custkey % 11)::VARCHAR AS pack, c_name, " + ", ".join(f"{x.replace('STRING', 'VARCHAR')} AS {n}" for n, x in _R.items()) + " FROM customer"


def _say(test, field, message):
    return f"CASE WHEN {test} THEN [{field if field.startswith('(') else lit(field)}, {lit(message)}] END"


_ERRORS = "list_filter([" + ", ".join(
    (
        _say("id IS NULL", "id", "Missing required field: id"), _say("name IS NULL", "name", "Missing required field: name"), _say("severity IS NULL", "severity", "Missing required field: severity"), _say("category IS NULL", "category", "Missing required field: category"),
        _say("ord % 2 <> 0", "languages", "Missing required field: languages"), _say("ord % 6 = 0", "message", "Missing required field: message"),
        _say("id <> '' AND NOT regexp_matches(id, '^[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]$')", "id", "Invalid ID format. Must be alphanumeric with hyphens."), _say("name <> '' AND length(name) < 3", "name", "Name must be at least 3 characters"), _say("length(name) > 100", "name", "Name must be at most 100 characters"),
        _say("NOT regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+$')", "version", "Version must be in semver format (x.y.z)"), _say("severity <> 'high'", "severity", "Invalid severity. Must be one of: critical, high, medium, low, info"),
        _say("category <> 'security'", "category", "Invalid category. Must be one of: security, quality, performance, style, best_practice, compliance, custom"), _say("ord % 6 <> 0 AND coalesce(message, '') = ''", "message.default", "Default message is required"),
        _say("ord % 10 <> 3 AND coalesce(ptype, '') NOT IN ('regex', 'ast')", "patterns[0].type", "Invalid pattern type. Must be one of: regex, ast, semantic, dataflow"), _say("ord % 10 <> 3 AND pvalue = ''", "patterns[0].value", "Pattern value is required"),
        _say("ord % 10 <> 3 AND ptype = 'regex' AND pvalue = '(a'", "patterns[0].value", "broken"),
    )
) + "], lambda x: x IS NOT NULL)"


@query(
    f"SELECT ord, array_to_string(list_transform(e, lambda x: x[1] || ': ' || x[2]), '; ') AS errors, len(e) = 0 AS valid, (ord % 4 = 0 OR true)::INT + (ord % 3 = 0 AND ord % 2 <> 0)::INT + (coalesce(category, '') = 'security' AND ord % 5 <> 0)::INT AS warnings FROM (SELECT *, {_ERRORS} AS e FROM ({_SHAPED}))"
)
def rule_validation(spark, sf):
    v = C.validate(shaped_rules(spark, sf))
    message = lambda e: F.when(F.startswith(e["message"], F.lit("Invalid regex pattern: ")), "broken").otherwise(e["message"])
    return v.select("ord", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), message(e))), "; ").alias("errors"), "valid", F.size("warnings").alias("warnings"))


@query(
    f"WITH v AS (SELECT *, {_ERRORS} AS e FROM ({_SHAPED})) SELECT pack, 'rules[' || ord || '].' || x[1] AS field, x[2] AS message FROM (SELECT pack, ord, unnest(e) AS x FROM v) "
    "UNION ALL SELECT pack, 'rules[' || ord || '].id', 'Duplicate rule ID: ' || id FROM (SELECT *, row_number() OVER (PARTITION BY pack, id ORDER BY ord) AS n FROM v) WHERE n > 1 AND id IS NOT NULL "
    "UNION ALL SELECT 'empty', 'name', 'Pack name is required' UNION ALL SELECT 'empty', 'rules', 'Pack must contain at least one rule'"
)
def rule_packs(spark, sf):
    rules = shaped_rules(spark, sf)
    packs = rules.select(F.col("pack").alias("id"), F.lit("a name").alias("name"), F.lit("1.0.0").alias("version")).distinct().unionByName(spark.createDataFrame([("empty", None, "1.0.0")], "id string, name string, version string"))
    out = C.validate_packs(rules, packs).filter("message is not null")
    return out.withColumn("message", F.when(F.startswith("message", F.lit("Invalid regex pattern: ")), "broken").otherwise(F.col("message")))


@query(f"SELECT count(*) FILTER (len({_ERRORS}) = 0) AS imported, count(*) FILTER (len({_ERRORS}) > 0) AS refused FROM ({_SHAPED})")
def rule_import(spark, sf):
    good, bad = C.imported(shaped_rules(spark, sf))
    return good.agg(F.count("*").alias("imported")).join(bad.agg(F.count("*").alias("refused")))


# custom matches over whole pages and documents; a split at marks around each match gives lines and columns in SQL
@query(
    f"SELECT key AS page_id, 'link to ' || m[7:-2] AS message, line, col AS \"column\", line + length(m) - length(replace(m, chr(10), '')) AS end_line, CASE WHEN contains(m, chr(10)) THEN length(string_split(m, chr(10))[-1]) ELSE col + length(m) END AS end_column, 0.9 AS confidence FROM ({positions(_RULES[3][5][0][0], 'SELECT page_id AS key, html AS body FROM pages')})"
)
def custom_matches(spark, sf):
    pages = table(spark, sf, "pages").withColumn("language", F.lit("html"))
    return C.match(pages, rule_table(spark, ("url-link",)), "page_id", "html", "language").select("page_id", "message", F.col("line").cast("long"), F.col("column").cast("long"), F.col("end_line").cast("long"), F.col("end_column").cast("long"), "confidence")


@query(
    f"SELECT key AS doc_id, count(*) AS n, min(line) AS first_line, sum(col)::BIGINT AS columns FROM ({positions('[Tt][Hh][Ee] [A-Za-z0-9_]+', 'SELECT doc_id AS key, text AS body FROM documents')}) GROUP BY 1"
)
def wordpositions(spark, sf):
    """Lines and columns of every match in whole documents."""
    d = table(spark, sf, "documents")
    found = d.select("doc_id", F.explode(match.matches(F.col("text"), "[Tt][Hh][Ee] [A-Za-z0-9_]+")).alias("m"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("m.line").cast("long").alias("first_line"), F.sum("m.col").alias("columns"))


_SOFT = [r for r in _RULES if r[0] in ("no-var", "long-run", "url-link")]


@query(
    "SELECT page_id, rule_id, count(*) AS n FROM (SELECT page_id, 'long-run' AS rule_id, unnest(regexp_extract_all(html, '(aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz)', 0, 'i')) FROM pages "
    "UNION ALL SELECT page_id, 'url-link', unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')) FROM pages WHERE len(regexp_extract_all(html, '(aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz)', 0, 'i')) < 2) GROUP BY ALL"
)
def custom_soft_limit(spark, sf):
    pages = table(spark, sf, "pages").withColumn("language", F.lit("html"))
    found = C.match(pages, rule_table(spark, ("long-run", "url-link")), "page_id", "html", "language", max_matches=2)
    return C.by_severity(found).groupBy("page_id", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT rule_id) AS rules_triggered, 80.0::DOUBLE AS coverage FROM (SELECT 'R' || (o_orderkey % 23) AS rule_id FROM orders)")
def rules_triggered(spark, sf):
    f = table(spark, sf, "orders").select(F.concat(F.lit("R"), (F.col("o_orderkey") % 23).cast("string")).alias("rule_id"))
    return C.coverage(f, 12, 15)
