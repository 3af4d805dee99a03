"""Queries on scalar functions, normalisation and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import normalize, scoring, text
from siltworks.operators import settings as S
from siltworks.registry import lit, query, table
from siltworks.session import dealt

_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(f"SELECT c_custkey, printf('%x', abs({_HASH.format('c_name')})) AS fingerprint FROM customer")
def fingerprints(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.poly_hash(F.col("c_name")).alias("fingerprint"))


@query(f"SELECT doc_id, printf('%x', abs({_HASH.format('text')})) AS fingerprint FROM documents WHERE text <> ''")
def text_fingerprints(spark, sf):
    d = table(spark, sf, "documents").filter("text != ''")
    return d.select("doc_id", text.poly_hash(F.col("text")).alias("fingerprint"))


_SANE = "regexp_replace(coalesce(html, ''), '[\\x00-\\x1F\\x7F]', '', 'g')"
for _raw, _safe in text.INPUT_ESCAPES:
    _SANE = f"replace({_SANE}, {lit(_raw)}, {lit(_safe)})"


@query(f"SELECT page_id, sha256(substr({_SANE}, 1, 200000)) AS digest FROM pages")
def sanitize_input(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.sanitize_input(F.col("html")), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN instr(url, '/') > 0 THEN substr(url, 1, instr(url, '/') - 1) || '|' || substr(url, instr(url, '/') + 1) ELSE url END AS fixed FROM pages")
def apply_fix(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.replace_first(F.col("url"), F.lit("/"), F.lit("|")).alias("fixed"))


_LINE = "string_split(html, chr(10))"


def _offset(line: str, column: str) -> str:
    """Characters before a place: of the lines before it, each with its end, and of its own line."""
    return f"CASE WHEN {line} > len({_LINE}) THEN length(html) ELSE coalesce(list_sum(list_transform({_LINE}[1:{line} - 1], lambda x: length(x) + 1)), 0) + least({column}, length({_LINE}[{line}])) END"


@query(
    f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html WHEN page_id % 3 = 0 AND contains(html, '<p>') THEN substr(html, 1, instr(html, '<p>') - 1) || 'NEW' || substr(html, instr(html, '<p>') + 3) "
    f"ELSE substr(html, 1, least(a, b)::BIGINT) || 'NEW' || substr(html, greatest(a, b)::BIGINT + 1) END AS fixed FROM (SELECT *, {_offset('l', 'c')} AS a, {_offset('m', 'd')} AS b FROM (SELECT page_id, html, (page_id % 4 + 1)::INT AS l, (page_id % 13)::INT AS c, (page_id % 6 + 1)::INT AS m, (CASE page_id % 9 WHEN 0 THEN 999 ELSE page_id % 9 END)::INT AS d FROM pages))"
)
def fixes_by_range(spark, sf):
    """A fix for each page: of a text where it is there, else of a range of lines and columns; every fifth has none."""
    k = F.col("page_id")
    n = lambda x: x.cast("int")
    new = F.when(k % 5 > 0, "NEW")
    return table(spark, sf, "pages").select("page_id", text.fixed(F.col("html"), F.when(k % 3 == 0, "<p>").otherwise("not there"), new, n(k % 4 + 1), n(k % 13), n(k % 6 + 1), n(k % 9)).alias("fixed"))


@query("SELECT event_id, 'type ' || event_type || ' at ' || coalesce(user_id::VARCHAR, '') || ', again {{type}} {{none}}' AS message FROM events")
def message_template(spark, sf):
    m = text.template(F.lit("type {{type}} at {{$1}}, again {{type}} {{none}}"), {"type": F.col("event_type"), "$1": F.col("user_id")})
    return table(spark, sf, "events").select("event_id", m.alias("message"))


@query(
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '[REDACTED]' END AS user_email, CASE WHEN regexp_matches(url, '[/\\\\]|^[~.]') THEN '<path-depth-' || len(regexp_split_to_array(url, '[/\\\\]')) || '>/<file>' || "
    "CASE WHEN contains(regexp_split_to_array(url, '[/\\\\]')[-1], '.') THEN '.' || string_split(regexp_split_to_array(url, '[/\\\\]')[-1], '.')[-1] ELSE '' END ELSE url END AS place, page_id::VARCHAR AS n, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 3 END AS size FROM pages"
)
def personal_properties(spark, sf):
    props = F.create_map(F.lit("user_email"), F.when(F.col("page_id") % 3 != 0, "a@b.c"), F.lit("place"), F.col("url"), F.lit("n"), F.col("page_id").cast("string"))
    p = table(spark, sf, "pages").select("page_id", text.anonymize_properties(props).alias("p"))
    return p.select("page_id", F.col("p")["user_email"].alias("user_email"), F.col("p")["place"].alias("place"), F.col("p")["n"].alias("n"), F.size("p").alias("size"))


@query("""SELECT event_id, '{"a":{"token":"[REDACTED]","b":{"n":' || event_id || '}},"list":["x/y"],"p":"<path-depth-2>/<file>.py"}' AS props FROM events""")
def personal_json(spark, sf):
    raw = F.concat(F.lit('{"a": {"token": "t", "none": null, "b": {"n": '), F.col("event_id").cast("string"), F.lit('}}, "list": ["x/y"], "p": "src/a.py"}'))
    return table(spark, sf, "events").select("event_id", text.anonymize_json(raw).alias("props"))


_PAYLOAD = "CASE event_id % 4 WHEN 0 THEN '{\"exp\": ' || (1700000000 + event_id * 10) || '}' WHEN 1 THEN '{\"sub\": \"x\"}' WHEN 2 THEN '{\"exp\":\"soon\"}' ELSE '{\"exp\":0}' END"


@query("SELECT event_id, event_id % 7 <> 0 AS valid, NOT (event_id % 7 <> 0 AND event_id % 4 = 0 AND 1700000000 + event_id * 10 >= 1700002000) AS expired FROM events")
def token_checks(spark, sf):
    body = F.translate(F.rtrim(F.base64(F.encode(F.expr(_PAYLOAD.replace('\\"', '"')), "UTF-8")), F.lit("=")), "+/", "-_")
    token = F.concat(F.when(F.col("event_id") % 7 == 0, "head er").otherwise("aGVhZA"), F.lit("."), F.replace(body, F.lit("\r\n"), F.lit("")), F.lit(".c2ln"))
    return table(spark, sf, "events").select("event_id", text.valid_token(token).alias("valid"), text.token_expired(token, F.lit(1700002000)).alias("expired"))


_MESSAGES = ("ECONNREFUSED by host", "request Timeout", "rate limit hit", "HTTP 503", "cancelled by user", "401 unauthorized", "validation failed", "config missing", "cache full", "odd thing")
_MESSAGE = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"
_ERRORS = ("NETWORK_ERROR", "TIMEOUT_ERROR", "RATE_LIMIT_ERROR", "SERVER_ERROR", "UNKNOWN_ERROR", "AUTH_ERROR", "VALIDATION_ERROR", "CONFIGURATION_ERROR", "CACHE_ERROR", "UNKNOWN_ERROR")


@query("SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERRORS)) + " END AS type, event_id % 10 < 4 AS retryable FROM events")
def error_types(spark, sf):
    m = F.expr(_MESSAGE)
    return table(spark, sf, "events").select("event_id", scoring.error_type(m).alias("type"), scoring.retryable(m).alias("retryable"))


@query("SELECT event_id, CASE WHEN floor(value + 0.5) >= 75 THEN 'CRITICAL' WHEN floor(value + 0.5) >= 50 THEN 'HIGH' WHEN floor(value + 0.5) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events")
def epss_bands(spark, sf):
    return table(spark, sf, "events").select("event_id", scoring.epss_band(F.col("value") / 100).alias("band"))


@query("SELECT doc_id, least(0.9, 0.2 + 0.1 * ((regexp_matches(text, 'test', 'i'))::INT + (regexp_matches(text, 'mock', 'i'))::INT + (regexp_matches(text, 'example', 'i'))::INT + (regexp_matches(text, 'sample', 'i'))::INT + (regexp_matches(text, 'placeholder', 'i'))::INT + (regexp_matches(text, 'demo', 'i'))::INT + (regexp_matches(text, 'todo', 'i'))::INT + (regexp_matches(text, 'fixme', 'i'))::INT) + 0.15 * (regexp_matches(text, '[0-9]{4}'))::INT)::DOUBLE AS likelihood FROM documents")
def false_positive_likelihood(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scoring.false_positive(F.col("text"), ["[0-9]{4}"]).alias("likelihood"))


# raw issues of several shapes, for both dialects
_RAW = {
    "id": "o_orderkey",
    "message": "CASE o_orderkey % 5 WHEN 0 THEN 'said' WHEN 1 THEN '' END",
    "title": "CASE o_orderkey % 3 WHEN 0 THEN 'titled' WHEN 1 THEN '' END",
    "category": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'open_redirect-kind' END",
    "severity": "CASE o_orderkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN '' END",
    "recommendation": "CASE o_orderkey % 2 WHEN 0 THEN 'do it' END",
    "line": "CASE WHEN o_orderkey % 9 < 5 THEN CAST(o_orderkey % 50 AS INT) - 1 END",
    "column": "CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderkey % 30 AS INT) - 2 END",
}
_LOC = {
    "startLine": "CASE WHEN o_orderkey % 8 < 6 THEN CAST(o_orderkey % 8 AS INT) END",
    "endLine": "CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 11 AS INT) END",
    "startColumn": "CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderkey % 13 AS INT) - 1 END",
    "endColumn": "CASE WHEN o_orderkey % 7 < 4 THEN CAST(o_orderkey % 21 AS INT) - 3 END",
}


def raw_issues(spark, sf):
    o = table(spark, sf, "orders")
    where = F.when(F.col("o_orderkey") % 3 == 0, F.struct(*(F.expr(x).alias(n) for n, x in _LOC.items())))
    return o.select(*(F.expr(x).alias(n) for n, x in _RAW.items()), where.alias("location"))


_RAW_SQL = "SELECT " + ", ".join(f'{x} AS "{n}"' for n, x in _RAW.items()) + ", o_orderkey % 3 = 0 AS has_loc, " + ", ".join(f"{x} AS {n}" for n, x in _LOC.items()) + " FROM orders"
_NORMAL = (
    "SELECT id, coalesce(nullif(message, ''), nullif(title, ''), regexp_replace(nullif(category, ''), '[_-]', ' ', 'g'), 'Code issue detected') AS message, coalesce(nullif(severity, ''), 'medium') AS severity, coalesce(nullif(category, ''), 'unknown') AS category, recommendation AS suggestion, "
    "CASE WHEN has_loc THEN greatest(0, coalesce(nullif(startLine, 0), 1) - 1) WHEN line IS NOT NULL THEN greatest(0, line - 1) ELSE 0 END AS start_line, "
    "CASE WHEN has_loc THEN greatest(0, coalesce(nullif(endLine, 0), nullif(startLine, 0), 1) - 1) WHEN line IS NOT NULL THEN greatest(0, line - 1) ELSE 0 END AS end_line, "
    "CASE WHEN has_loc THEN greatest(0, coalesce(startColumn, 0)) WHEN line IS NOT NULL THEN greatest(0, coalesce(\"column\", 0)) ELSE 0 END AS start_col, "
    "CASE WHEN has_loc THEN CASE WHEN endColumn IS NOT NULL THEN greatest(0, endColumn) ELSE greatest(0, coalesce(startColumn, 0)) + 100 END WHEN line IS NOT NULL THEN greatest(0, coalesce(\"column\", 0)) + 100 ELSE 100 END AS end_col "
    f"FROM ({_RAW_SQL})"
)


@query(f"SELECT *, CASE severity WHEN 'critical' THEN 'Error' WHEN 'high' THEN 'Error' WHEN 'medium' THEN 'Warning' WHEN 'low' THEN 'Information' ELSE 'Hint' END AS level FROM ({_NORMAL})")
def diagnostics(spark, sf):
    return normalize.diagnostics(raw_issues(spark, sf)).select("id", "message", "severity", "category", "suggestion", "range.start_line", "range.end_line", "range.start_col", "range.end_col", "level")


@query(f"SELECT count(*) AS n, count(*) FILTER (severity = 'medium') AS medium FROM ({_NORMAL}) WHERE severity <> 'info'")
def without_info(spark, sf):
    return normalize.without_info(normalize.issues(raw_issues(spark, sf))).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "medium").alias("medium"))


@query("SELECT id, CASE WHEN message IS NULL THEN 'message is missing' WHEN try_cast(title AS INT) IS NULL THEN CASE WHEN title IS NULL THEN 'title is missing' ELSE 'title is not of type int' END ELSE 'absent is missing' END AS invalid, coalesce(severity, 'medium') AS severity, 7 AS absent FROM (" + _RAW_SQL + ")")
def response_checks(spark, sf):
    c = normalize.checked(raw_issues(spark, sf), {"message": "string", "title": "int", "absent": "string"})
    return normalize.defaulted(c, {"severity": "medium", "absent": 7}).select("id", "invalid", "severity", "absent")


_SETTING_ROWS = "(VALUES " + ", ".join(f"({i}, {lit(s.key)}, {lit(s.default)}, {lit(s.type)})" for i, s in enumerate(S.SCHEMA)) + ") AS s(ord, key, fallback, want)"
_PICK = "(c_custkey * 7 + ord) % 11"
_SETTINGS = (
    f"SELECT c_custkey AS profile, key, CASE {_PICK} WHEN 1 THEN '' WHEN 2 THEN '-1' WHEN 3 THEN '99999999999' WHEN 4 THEN 'true' WHEN 5 THEN 'https://host/x' ELSE fallback END AS value, "
    f"CASE {_PICK} WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' WHEN 5 THEN 'string' ELSE want END AS type FROM customer, {_SETTING_ROWS} WHERE {_PICK} <> 0"
)
_RULES = "(VALUES " + ", ".join(f"({i}, {lit(s.key)}, {lit(s.type)}, {str(s.required).lower()}, {lit(', '.join(s.enum))}, {'NULL' if s.least is None else int(s.least)}::BIGINT, {'NULL' if s.most is None else int(s.most)}::BIGINT)" for i, s in enumerate(S.SCHEMA)) + ") AS r(ord, key, want, required, enum, least, most)"


def settings(spark, sf):
    keys = S.schema_table(spark).select("ord", "key", "fallback", "want")
    rows = dealt(table(spark, sf, "customer").select("c_custkey"), 20_000).join(F.broadcast(keys))  # the schema has a fixed number of rows
    pick = F.expr(_PICK)
    value = F.when(pick == 1, "").when(pick == 2, "-1").when(pick == 3, "99999999999").when(pick == 4, "true").when(pick == 5, "https://host/x").otherwise(F.col("fallback"))
    kind = F.when(pick.isin(1, 5), "string").when(pick.isin(2, 3), "number").when(pick == 4, "boolean").otherwise(F.col("want"))
    return rows.filter(pick != 0).select(F.col("c_custkey").alias("profile"), "key", value.alias("value"), kind.alias("type"))


_CHECKED = (
    "SELECT c_custkey AS profile, r.key, value, CASE WHEN required AND (type IS NULL OR value = '') THEN r.key || ' is required but not set' WHEN type IS NULL THEN NULL WHEN type <> want THEN r.key || ' must be of type ' || want "
    "WHEN enum <> '' AND NOT list_contains(string_split(enum, ', '), value) THEN r.key || ' must be one of: ' || enum WHEN want = 'number' AND try_cast(value AS DOUBLE) < least THEN r.key || ' must be at least ' || least || ' (current: ' || value || ')' "
    "WHEN want = 'number' AND try_cast(value AS DOUBLE) > most THEN r.key || ' must be at most ' || most || ' (current: ' || value || ')' END AS error, type "
    f"FROM customer CROSS JOIN {_RULES} LEFT JOIN ({_SETTINGS}) v ON v.profile = c_custkey AND v.key = r.key"
)


@query(
    f"SELECT profile, key, 'error' AS kind, error AS message FROM ({_CHECKED}) WHERE error IS NOT NULL UNION ALL SELECT profile, key, 'warning', CASE key WHEN 'apiKey' THEN 'Storing API key in settings is deprecated. Use SecretStorage instead.' ELSE 'API endpoint should use HTTPS for security' END "
    f"FROM ({_CHECKED}) WHERE error IS NULL AND type IS NOT NULL AND (key = 'apiKey' AND trim(value) <> '' OR key = 'apiEndpoint' AND NOT starts_with(value, 'https:'))"
)
def settings_validation(spark, sf):
    return S.validate(settings(spark, sf)).select("profile", "key", "kind", "message")


@query(
    f"SELECT profile, key, CASE WHEN key = 'apiEndpoint' AND starts_with(value, 'http:') THEN 'https:' || substr(value, 6) ELSE value END AS value, type FROM ({_SETTINGS}) "
    f"UNION ALL SELECT c_custkey, k, 'true', 'boolean' FROM customer, (VALUES ('cacheEnabled'), ('retryEnabled')) AS f(k) WHERE NOT EXISTS (SELECT 1 FROM ({_SETTINGS}) WHERE profile = c_custkey AND key = k)"
)
def settings_migration(spark, sf):
    return S.migrate(settings(spark, sf), "1.4.2")


@query(f"SELECT profile, count(*) AS n, min(key) AS first_key FROM ({_SETTINGS}) WHERE key <> 'apiKey' GROUP BY 1")
def settings_import(spark, sf):
    rows = settings(spark, sf).unionByName(settings(spark, sf).withColumn("key", F.lit("aaa")))
    # the least known key by its place in a fixed list: numbers are aggregated by hashing, texts by sorting all rows of a task
    keys = F.array(*map(F.lit, sorted(s.key for s in S.SCHEMA)))
    found = S.importable(rows).groupBy("profile").agg(F.count("*").alias("n"), F.min(F.array_position(keys, F.col("key"))).alias("place"))
    return found.select("profile", "n", F.element_at(keys, F.col("place").cast("int")).alias("first_key"))


@query(f"SELECT profile, key, CASE WHEN key = 'apiKey' AND value <> '' THEN '[REDACTED]' ELSE value END AS value FROM ({_SETTINGS})")
def settings_export(spark, sf):
    return S.exported(settings(spark, sf)).select("profile", "key", "value")
