"""Queries on report documents and file scans. Findings are made of ``orders`` by one list of expressions for both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import severity as severities
from siltworks.registry import lit, query, table
from siltworks.sources import files, reports

_COLUMNS = {
    "seq": "o_orderkey",
    "id": "concat('i', CAST(o_orderkey AS STRING))",
    "rule_id": "concat('R', CAST(o_orderkey % 23 AS STRING))",
    "rule_name": "concat('Rule, \"', CAST(o_orderkey % 23 AS STRING), '\" & <co>')",
    "severity": "CASE o_orderkey % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN 'odd' ELSE 'high' END",
    "category": "CASE o_orderkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style' ELSE 'x<y' END",
    "message": "concat('found \"', CAST(o_orderkey AS STRING), '\", a<b>')",
    "description": "CASE o_orderkey % 5 WHEN 0 THEN 'long text' WHEN 1 THEN '' END",
    "file": "concat('src/f', CAST(o_custkey AS STRING), CASE o_custkey % 3 WHEN 0 THEN ',a.py' ELSE '&b.js' END)",
    "line": "o_orderkey % 200 + 1",
    "column": "o_orderkey % 50",
    "end_line": "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 200 + 3 END",
    "end_column": "CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 50 + 7 END",
    "confidence": "CASE o_orderkey % 3 WHEN 0 THEN 0.75D WHEN 1 THEN 1D ELSE 0.5D END",
    "cwe": "CASE o_orderkey % 3 WHEN 0 THEN ARR('CWE-1', 'CWE-2') WHEN 1 THEN ARR('CWE-3') END",
    "owasp": "CASE o_orderkey % 4 WHEN 0 THEN ARR('A01') END",
    "fix_available": "o_orderkey % 2 = 0",
    "suggestion": "CASE o_orderkey % 3 WHEN 0 THEN 'use > x' WHEN 1 THEN '' END",
    "snippet": "CASE o_orderkey % 5 WHEN 0 THEN 'if a < b:' END",
    "cvss": "CASE o_orderkey % 2 WHEN 0 THEN 7.5D ELSE 9D END",
}


def findings(spark, sf):
    return table(spark, sf, "orders").selectExpr(*(f"{x.replace('ARR(', 'array(')} AS {n}" for n, x in _COLUMNS.items()))


def _duck(x: str) -> str:
    return x.replace("ARR(", "list_value(").replace("0.75D", "0.75::DOUBLE").replace("0.5D", "0.5::DOUBLE").replace("7.5D", "7.5::DOUBLE").replace(" 1D", " 1::DOUBLE").replace(" 9D", " 9::DOUBLE")


_F = "SELECT " + ", ".join(f'{_duck(x)} AS "{n}"' for n, x in _COLUMNS.items()) + " FROM orders"
META = reports.Meta(title="Scan <1>", generated_at="2024-01-01T00:00:00Z", repository="repo", branch="main", score=70, grade="C", analysis_ms=1500, snippets=True, fixes=True, group_by="category")


def _document(*parts: tuple) -> str:
    """part, section, place, step, seq, text and where from, of each part."""
    return f"WITH f AS ({_F}), n AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (lower(severity) = '{s}') AS {s}" for s in severities.ORDER) + " FROM f) " + " UNION ALL ".join(
        f"SELECT {part}::INT AS part, ({section})::INT AS section, ({place})::BIGINT AS place, {step}::INT AS step, ({seq})::BIGINT AS seq, {text} AS text FROM {source}" for part, section, place, step, seq, text, source in parts
    )


def _esc(x: str, quote: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        x = f"replace({x}, {lit(raw)}, {lit(safe)})"
    return x


def _csv(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[,\"\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


def _number(x: str) -> str:
    return f"regexp_replace({x}::VARCHAR, '\\.0$', '')"


@query(
    _document(
        (0, 0, "NULL", 1, "NULL", lit("ID,Rule ID,Rule Name,Severity,Category,Message,File,Line,Column,Confidence,CWE,OWASP,Fix Available"), "n"),
        (1, 0, "NULL", 1, "seq", f"concat_ws(',', id, rule_id, {_csv('rule_name')}, severity, category, {_csv('message')}, {_csv('file')}, line, \"column\", {_number('confidence')}, coalesce(array_to_string(cwe, ';'), ''), coalesce(array_to_string(owasp, ';'), ''), CASE WHEN fix_available THEN 'Yes' ELSE 'No' END)", "f"),
    )
)
def report_csv(spark, sf):
    return reports.document(findings(spark, sf), "csv", META)


_LEVEL = "CASE lower(severity) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning' END"
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


def _json(*pairs: tuple[str, str | None]) -> str:
    """A JSON object; a value that is null leaves its key out. Values are SQL of JSON text."""
    return "'{' || concat_ws(',', " + ", ".join(f"{lit(chr(34) + k + chr(34) + ':')} || ({v})" for k, v in pairs) + ") || '}'"


def _str(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _list(f: str) -> str:
    return f"CASE WHEN seq = (SELECT min(seq) FROM {f}) THEN '' ELSE ',' END"


_CLIMATE = _json(
    ("type", lit('"issue"')), ("check_name", _str("rule_id")), ("description", _str("message")), ("content", _json(("body", _str("coalesce(nullif(description, ''), message)")))),
    ("categories", "CASE category WHEN 'security' THEN '[\"Security\"]' ELSE '[\"Bug Risk\"]' END"),
    ("severity", _str("CASE lower(severity) WHEN 'critical' THEN 'blocker' WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'major' WHEN 'low' THEN 'minor' WHEN 'info' THEN 'info' ELSE 'minor' END")),
    ("fingerprint", _str("lpad(printf('%x', abs(" + _HASH.format("concat_ws(':', rule_id, file, line, message)") + ")), 32, '0')")),
    ("location", _json(("path", _str("file")), ("lines", _json(("begin", "line::VARCHAR"), ("end", "coalesce(nullif(end_line, 0), line)::VARCHAR"))))),
)


@query(_document((0, 0, "NULL", 1, "NULL", "'['", "n"), (1, 0, "NULL", 1, "seq", f"{_list('f')} || {_CLIMATE}", "f"), (2, 0, "NULL", 1, "NULL", "']'", "n")))
def report_code_climate(spark, sf):
    return reports.document(findings(spark, sf), "codeclimate", META)


_RULE = _json(
    ("id", _str("rule_id")), ("name", _str("rule_name")), ("shortDescription", _json(("text", _str("rule_name")))), ("fullDescription", _json(("text", _str("coalesce(nullif(description, ''), message)")))),
    ("defaultConfiguration", _json(("level", _str(_LEVEL)))),
    ("properties", _json(("category", _str("category")), ("tags", "to_json(CASE WHEN cwe IS NULL THEN [] ELSE list_concat(cwe, coalesce(owasp, [])) END)::VARCHAR"), ("security_severity", _str(_number("cvss"))))),
)
_RESULT = _json(
    ("ruleId", _str("rule_id")), ("ruleIndex", "rule_index::VARCHAR"), ("level", _str(_LEVEL)), ("message", _json(("text", _str("message")))),
    ("locations", "'[' || " + _json(("physicalLocation", _json(("artifactLocation", _json(("uri", _str("file")), ("uriBaseId", lit('"%SRCROOT%"')))), ("region", _json(("startLine", "line::VARCHAR"), ("startColumn", "\"column\"::VARCHAR"), ("endLine", "coalesce(nullif(end_line, 0), line)::VARCHAR"), ("endColumn", "coalesce(nullif(end_column, 0), \"column\" + 1)::VARCHAR"), ("snippet", _json(("text", _str("snippet"))).replace("concat_ws(',', ", "CASE WHEN snippet <> '' THEN concat_ws(',', ").replace(") || '}'", ") END || '}'"))))))) + " || ']'"),
    ("partialFingerprints", _json(("primaryLocationLineHash", _str("printf('%x', abs(" + _HASH.format("concat_ws(':', file, line, rule_id)") + "))")))),
    ("fixes", "CASE WHEN fix_available AND suggestion <> '' THEN '[' || " + _json(("description", _json(("text", _str("suggestion"))))) + " || ']' END"),
    ("properties", _json(("confidence", "confidence::VARCHAR"), ("category", _str("category")), ("cwe", "to_json(cwe)::VARCHAR"), ("owasp", "CASE WHEN owasp IS NOT NULL THEN to_json(owasp)::VARCHAR END"))),
)


@query(
    _document(
        (1, 0, "NULL", 1, "seq", f"CASE WHEN seq = (SELECT min(seq) FROM f) THEN '' ELSE ',' END || {_RULE}", "(SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS nth FROM f) WHERE nth = 1"),
        (3, 0, "NULL", 1, "seq", f"{_list('f')} || {_RESULT}", "f JOIN (SELECT rule_id AS r, row_number() OVER (ORDER BY min(seq)) - 1 AS rule_index FROM f GROUP BY 1) ON r = rule_id"),
    )
)
def report_sarif(spark, sf):
    return reports.document(findings(spark, sf), "sarif", META).filter("part IN (1, 3)")


_FAILED = "lower(severity) IN ('critical', 'high')"
_XML = lambda x: _esc(x, "&apos;")
_FILES = "(SELECT file, count(*) AS n, min(seq) AS first, count(*) FILTER (lower(severity) IN ('critical', 'high')) AS failures FROM f GROUP BY file)"


@query(
    _document(
        (0, 0, "NULL", 1, "NULL", "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<testsuites name=\"Security Analysis\" tests=\"' || total || '\" failures=\"' || (critical + high) || '\" errors=\"0\" time=\"1.5\">'", "n"),
        (1, 0, "first", 0, "NULL", f"'  <testsuite name=\"' || {_XML('file')} || '\" tests=\"' || n || '\" failures=\"' || failures || '\" errors=\"0\">'", _FILES),
        (1, 0, "first", 1, "seq", f"'    <testcase name=\"' || {_XML('rule_name')} || '\" classname=\"' || {_XML('file')} || '\">' || CASE WHEN {_FAILED} THEN chr(10) || '      <failure message=\"' || {_XML('message')} || '\" type=\"' || severity || '\">' || chr(10) || 'Location: ' || file || ':' || line || ':' || \"column\" || CASE WHEN snippet <> '' THEN chr(10) || chr(10) || {_XML('snippet')} ELSE '' END || chr(10) || '      </failure>' ELSE '' END || chr(10) || '    </testcase>'", f"f JOIN (SELECT file AS k, first FROM {_FILES}) ON k = file"),
        (1, 0, "first", 2, "NULL", "'  </testsuite>'", _FILES),
        (2, 0, "NULL", 1, "NULL", "'</testsuites>'", "n"),
    )
)
def report_junit(spark, sf):
    return reports.document(findings(spark, sf), "junit", META)


_RANK = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 END"
_NAMES = "CASE r WHEN 0 THEN '🔴 Critical' WHEN 1 THEN '🟠 High' WHEN 2 THEN '🟡 Medium' WHEN 3 THEN '🟢 Low' ELSE 'ℹ️ Info' END"


@query(
    _document(
        (0, 0, "NULL", 1, "NULL", "concat_ws(chr(10), '# Scan <1>', '', '> Generated on 2024-01-01T00:00:00Z', '', '**Repository:** repo', '**Branch:** main', '', '## Summary', '', '| Severity | Count |', '|----------|-------|', '| 🔴 Critical | ' || critical || ' |', '| 🟠 High | ' || high || ' |', '| 🟡 Medium | ' || medium || ' |', '| 🟢 Low | ' || low || ' |', '| ℹ️ Info | ' || info || ' |', '| **Total** | **' || total || '** |', '', '**Security Score:** 70/100 (C)', '')", "n"),
        (1, "r", "NULL", 0, "NULL", f"'## ' || {_NAMES} || ' Issues (' || n || ')' || chr(10)", f"(SELECT {_RANK} AS r, count(*) AS n FROM f GROUP BY 1) WHERE r IS NOT NULL"),
        (1, _RANK, "NULL", 1, "seq", "'### ' || rule_name || chr(10) || chr(10) || '**File:** `' || file || ':' || line || ':' || \"column\" || '`' || chr(10) || chr(10) || message || chr(10) || chr(10) || CASE WHEN snippet <> '' THEN '```' || chr(10) || snippet || chr(10) || '```' || chr(10) || chr(10) ELSE '' END || CASE WHEN suggestion <> '' THEN '**💡 Suggestion:** ' || suggestion || chr(10) || chr(10) ELSE '' END || CASE WHEN len(cwe) > 0 THEN '**CWE:** ' || array_to_string(cwe, ', ') || chr(10) ELSE '' END || CASE WHEN len(owasp) > 0 THEN '**OWASP:** ' || array_to_string(owasp, ', ') || chr(10) ELSE '' END || chr(10) || '---' || chr(10)", f"f WHERE {_RANK} IS NOT NULL"),
        (2, 0, "NULL", 1, "NULL", "'*Generated by siltworks v1.0.0*'", "n"),
    )
)
def report_markdown(spark, sf):
    return reports.document(findings(spark, sf), "markdown", META)


_E = lambda x: _esc(f"coalesce({x}, '')", "&#039;")
_GROUPS = "(SELECT category, count(*) AS n, min(seq) AS first FROM f GROUP BY category)"


_HTML_HEAD = (
    "'<!DOCTYPE html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head><meta charset=\"UTF-8\"><title>Scan &lt;1&gt;</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>Scan &lt;1&gt;</h1>' || chr(10) || '<p>2024-01-01T00:00:00Z</p>' || chr(10) || "
    + " || ".join(f"'<div class=\"card {s}\"><b>' || {s} || '</b> {s.capitalize()}</div>'" for s in ("critical", "high", "medium", "low", "info"))
    + " || '<div class=\"card\"><b>' || total || '</b> Total</div>'"
)


@query(
    _document(
        (1, 0, "first", 0, "NULL", f"'<section><h3>' || {_E('category')} || ' (' || n || ')</h3>'", _GROUPS),
        (1, 0, "first", 1, "seq", f"'<div class=\"issue\"><b>' || {_E('rule_name')} || '</b> <i class=\"' || lower(severity) || '\">' || severity || '</i> <i>' || {_E('category')} || '</i><p>📁 ' || {_E('file')} || ':' || line || ':' || \"column\" || '</p><p>' || {_E('message')} || '</p>' || CASE WHEN snippet <> '' THEN '<pre>' || {_E('snippet')} || '</pre>' ELSE '' END || CASE WHEN suggestion <> '' THEN '<p>💡 ' || {_E('suggestion')} || '</p>' ELSE '' END || '<small>' || floor(confidence * 100 + 0.5)::BIGINT || '%' || CASE WHEN len(cwe) > 0 THEN ' ' || array_to_string(cwe, ', ') ELSE '' END || CASE WHEN fix_available THEN ' 🔧' ELSE '' END || '</small></div>'", f"f JOIN (SELECT category AS k, first FROM {_GROUPS}) ON k = category"),
        (1, 0, "first", 2, "NULL", "'</section>'", _GROUPS),
        (0, 0, "NULL", 1, "NULL", _HTML_HEAD, "n"),
        (2, 0, "NULL", 1, "NULL", "'</body>' || chr(10) || '</html>'", "n"),
    )
)
def report_html(spark, sf):
    """The whole page."""
    return reports.document(findings(spark, sf), "html", META)


_TEXTS, _NUMBERS, _LISTS = ("id", "rule_id", "rule_name", "severity", "category", "message", "description", "file", "suggestion", "snippet"), ("line", "column", "end_line", "end_column", "confidence", "fix_available", "cvss"), ("cwe", "owasp")


def _field(name: str) -> str:
    """A field of an object of JSON with the comma before it, or nothing where it is null."""
    c = f'"{name}"'
    inner = f"'\"' || replace({c}, '\"', '\\\"') || '\"'" if name in _TEXTS else f"'[\"' || array_to_string({c}, '\",\"') || '\"]'" if name in _LISTS else f"{c}::VARCHAR"
    return f"CASE WHEN {c} IS NOT NULL THEN ',\"{name}\":' || {inner} ELSE '' END"


_ISSUE = "'{' || substr(" + " || ".join(_field(n) for n in reports._COLUMNS) + ", 2) || '}'"


@query(_document((0, 0, "NULL", 1, "NULL", "'{\"metadata\":{\"title\":\"Scan <1>\",\"generatedAt\":\"2024-01-01T00:00:00Z\"},\"summary\":{\"totalIssues\":' || total || ',\"criticalCount\":' || critical || ',\"highCount\":' || high || ',\"mediumCount\":' || medium || ',\"lowCount\":' || low || ',\"infoCount\":' || info || '},\"issues\":['", "n"), (1, 0, "NULL", 1, "seq", f"{_list('f')} || {_ISSUE}", "f"), (2, 0, "NULL", 1, "NULL", "']}'", "n")))
def report_json(spark, sf):
    """The whole document."""
    return reports.document(findings(spark, sf), "json", META)


@query(f"SELECT seq FROM (SELECT * FROM ({_F}) WHERE lower(severity) NOT IN ('low', 'info') ORDER BY confidence DESC, seq LIMIT 25)")
def report_selection(spark, sf):
    return reports.select(findings(spark, sf), "medium", 25, "confidence").select("seq")


@query(f"SELECT rule_id, rule_index, {_LEVEL} AS level, count(*) AS n FROM ({_F}) JOIN (SELECT rule_id AS r, row_number() OVER (ORDER BY min(seq)) - 1 AS rule_index FROM ({_F}) GROUP BY 1) ON r = rule_id GROUP BY ALL")
def report_sarif_levels(spark, sf):
    f = reports.sarif_results(reports.canonical(findings(spark, sf)), META)
    return f.groupBy("rule_id", "rule_index", "level").agg(F.count("*").alias("n"))


# files: each order is a file of a project
_PLACES = ("src/a.ts", "src/b.PY", "node_modules/x.js", "lib/c.rs", "main.go", "docs/readme.md", "dist/d.java", "web/e.cs", "x/package.json", "vendor/go.mod", "requirements-dev.txt", "app.csproj", "noext")
_PATH = f"concat(CAST(o_orderkey AS STRING), '/', CASE o_orderkey % {len(_PLACES)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLACES)) + " END)"
_FILE_SQL = f"SELECT {_PATH} AS path, repeat('x', CAST(o_orderkey % 40 AS INT)) AS content, o_custkey FROM orders"


def project_files(spark, sf):
    return table(spark, sf, "orders").selectExpr(f"{_PATH} AS path", "repeat('x', CAST(o_orderkey % 40 AS INT)) AS content", "o_custkey")


_EXT = "CASE WHEN contains(string_split(path, '/')[-1], '.') THEN lower(string_split(string_split(path, '/')[-1], '.')[-1]) ELSE '' END"


@query(f"SELECT path FROM (SELECT * FROM ({_FILE_SQL}) WHERE {_EXT} IN ('ts', 'tsx', 'js', 'jsx', 'py', 'go', 'java', 'rb', 'cs', 'php') AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build)/') ORDER BY path LIMIT 60) WHERE length(content) <= 25 ORDER BY path LIMIT 30")
def project_scan(spark, sf):
    return files.project(project_files(spark, sf), 30, 25).select("path")


@query(f"SELECT path, array_to_string(CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN [{', '.join(map(lit, n))}]" for e, n in files.LANGUAGES.items()) + f" ELSE [] END, ',') AS languages FROM ({_FILE_SQL})")
def file_languages(spark, sf):
    return project_files(spark, sf).select("path", F.array_join(files.languages(F.col("path")), ",").alias("languages"))


_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(string_split(path, '/')[-1], {lit('^' + m.replace('.', chr(92) + '.').replace('*', '.*') + '$')}) THEN {i}" for i, m in enumerate(files.MANIFESTS)) + " END"


@query(f"SELECT path, pattern FROM (SELECT *, row_number() OVER (PARTITION BY bucket, pattern ORDER BY path) AS nth FROM (SELECT path, o_custkey % 5 AS bucket, {_NAMED} AS pattern FROM ({_FILE_SQL})) WHERE pattern IS NOT NULL AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|vendor|target)/')) WHERE nth <= 10")
def manifest_files(spark, sf):
    rows = project_files(spark, sf).withColumn("bucket", F.col("o_custkey") % 5)
    return files.manifests(rows, key=["bucket"]).select("path", "pattern")
