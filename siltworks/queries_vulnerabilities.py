"""Queries on vulnerabilities. The rows are made of ``documents`` by one list of expressions for both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import vulnerabilities as V
from siltworks.plans import vulnerabilities as P
from siltworks.registry import lit, query, spark_lit, table

SNIPPETS = (
    "jdbcTemplate.query(q, id, ?)", "jdbcTemplate.query(q)", "PreparedStatement p; p.setString(1, x)", "cursor.execute(q, (x,))", "session.query(User)", "print('SELECT * FROM t')",
    "ast.literal_eval(x)", "JSON.parse(body)", "setTimeout(run, 100)", "subprocess.run(cmd, shell=False)", "subprocess.run([cmd])", "exec('ls -l')", "el.textContent = x",
    "DOMPurify.sanitize(x)", "htmlspecialchars($x)", "escapeHtml(x)", "path.resolve(p)", "open('a.txt', 'r')", "password = 'changeme'", "os.environ['API_KEY'] # secret",
    "// SELECT a FROM b WHERE c", "logger.info(sample)", "query(SELECT x FROM y WHERE cursor)", "console.log(x); eval(y)",
)
_TYPES = ("sql_injection", "command_injection", "xss", "path_traversal", "code_injection", "hardcoded_credentials", "weak-random", "SSRF check", "")
_LANGS = ("python", "Java", "javascript", "php", None, "")


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else '@' + str(j)}" for i, v in enumerate(values) for j in [None if v is None else _HELD.setdefault(v, len(_HELD))]) + " END" if values else "NULL"


#: Texts of the expressions below; ``@n`` stands for the n-th, as a literal of the dialect.
_HELD: dict[str, int] = {}
_ROWS = {
    "id": "doc_id",
    "report": "source",
    "type": _case("doc_id % 9", _TYPES),
    "title": _case("doc_id % 4", ("Cross-Site Scripting", "SQL Injection in login", None, "")),
    "language": _case("doc_id % 6", _LANGS),
    "language_confidence": "CASE WHEN doc_id % 7 = 3 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) / 10 END",
    "detected_language": "CASE WHEN source IS NULL THEN NULL ELSE lang END",
    "snippet": _case(f"(doc_id * 7 + doc_id % 5) % {len(SNIPPETS) + 1}", (*SNIPPETS, None)),
    "file": _case("doc_id % 8", ("src/app.py", "src/app_test.py", "lib/specs.ts", "Main.java", None, "mock.js", "web/index.js", "tests.md")),
    "lines": "CASE WHEN doc_id % 10 = 0 THEN ARR() WHEN doc_id % 10 = 1 THEN ARR(CAST(0 AS INT), CAST(4 AS INT)) WHEN doc_id % 10 = 2 THEN ARR(CAST(5 AS INT), CAST(130 AS INT)) WHEN doc_id % 10 = 3 THEN NULL ELSE ARR(CAST(doc_id % 90 + 1 AS INT), CAST(doc_id % 90 + doc_id % 60 AS INT) + 1) END",
    "severity": _case("doc_id % 5", ("CRITICAL", "HIGH", "MEDIUM", "LOW", "ODD")),
    "confidence": "CASE WHEN doc_id % 13 = 5 THEN NULL ELSE CAST(doc_id % 21 AS DOUBLE) / 20 END",
    "confidence_level": _case("doc_id % 3", ("HIGH", "LOW", None)),
    "patterns": "CASE WHEN doc_id % 3 = 0 THEN ARR(source) WHEN doc_id % 3 = 1 THEN NULL ELSE ARR() END",
    "indicators": "CASE WHEN doc_id % 14 = 0 THEN ARR(@A) WHEN doc_id % 14 = 1 THEN ARR(@B, source) WHEN doc_id % 14 < 5 THEN ARR() ELSE NULL END",
    "cwe": _case("doc_id % 2", ("CWE-89", "")),
    "owasp": _case("doc_id % 4", ("A03:2021", None, "", "A01:2021")),
    "vulnerable_code": "CASE WHEN doc_id % 5 < 3 THEN source END",
    "secure_code": "CASE WHEN doc_id % 7 < 5 THEN source END",
    "impact": "substr(text, 1, CAST(doc_id % 40 AS INT))",
    "known_exploited": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 8 = 0 END",
    "kev_date": _case("doc_id % 3", ("2023-05-01", "", None)),
    "epss": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 101 AS DOUBLE) / 100 END",
    "cvss": "CASE WHEN doc_id % 11 = 10 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) END",
    "business_logic": "doc_id % 6 = 1",
    "architectural": "CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id % 4 = 1 END",
}
_HELD |= {"Public EXPLOIT known": 9001, "see PoC": 9002}


def _dialect(sql: str, quote, array: str) -> str:
    for text, n in sorted(_HELD.items(), key=lambda x: -x[1]):
        sql = sql.replace({9001: "@A", 9002: "@B"}.get(n, f"@{n}"), quote(text))
    return sql.replace("ARR(", array + "(")


def vulnerabilities(spark, sf):
    strings = {"patterns", "indicators"}
    cast = lambda n, x: f"CAST({x} AS array<string>)" if n in strings else f"CAST({x} AS array<int>)" if n == "lines" else x
    return table(spark, sf, "documents").selectExpr(*(f"{cast(n, _dialect(x, spark_lit, 'array'))} AS {n}" for n, x in _ROWS.items()))


VULNS = "SELECT " + ", ".join(f"{_dialect(x, lit, 'list_value')} AS {n}" for n, x in _ROWS.items()) + " FROM documents"
_KIND = "lower(coalesce(nullif(type, ''), nullif(title, ''), ''))"
_SNIP = "coalesce(snippet, '')"
_LANG = "lower(coalesce(language, ''))"


def _named(kind, types):
    return "(" + " OR ".join(f"contains({kind}, {lit(t.lower())})" for t in types) + ")"


def _re(col, regex, flags="i"):
    return f"regexp_matches({col}, {lit(regex)}, '{flags}')"


def _fp_test(p):
    lang = "true" if "any" in p.languages else f"{_LANG} IN ({', '.join(map(lit, p.languages))})"
    return f"{_named(_KIND, p.types)} AND {lang} AND {_re(_SNIP, p.regex)}" + (f" AND {_re(_SNIP, p.context)}" if p.context else "")


_EARLY = f"{_re('coalesce(file, ' + lit('') + ')', P.TEST_FILE)} OR {_re(_SNIP, P.EXAMPLE)}"


def _fp_case(pick, user="NULL", comment="NULL"):
    """The value of the first pattern that fits, written backwards as nested choices."""
    out = f"CASE WHEN NOT ({_EARLY}) AND {_re(_SNIP, P.COMMENT, 'm')} THEN {comment} END"
    for p in reversed(P.FALSE_POSITIVES):
        out = f"CASE WHEN {_fp_test(p)} THEN {pick(p)} ELSE {out} END"
    return f"CASE WHEN id % 50 = 7 THEN {user} ELSE {out} END"


@query(
    f"SELECT id, {_fp_case(lambda p: lit(p.id), lit('user'), lit('comment'))} AS pattern, {_fp_case(lambda p: p.confidence, '1.0', '0.85')}::DOUBLE AS confidence, "
    f"{_fp_case(lambda p: lit(p.reason), lit('User suppressed'), lit('Vulnerability in commented code'))} AS reason, {_fp_case(lambda p: lit(p.classification))} AS classification, "
    f"CASE WHEN s IS NULL THEN 'kept' WHEN s THEN 'removed' ELSE 'warned' END AS status FROM (SELECT *, {_fp_case(lambda p: str(p.suppress).lower(), 'true', 'true')} AS s FROM ({VULNS}))"
)
def false_positives(spark, sf):
    v = vulnerabilities(spark, sf)
    user = v.filter("id % 50 = 7").select("id")
    found = V.partition(V.detect_false_positives(v, user))
    return found.select("id", "fp.pattern", "fp.confidence", "fp.reason", "fp.classification", "status")


@query(f"SELECT count(*) AS kept FROM ({VULNS}) WHERE NOT coalesce({_fp_case(lambda p: str(p.suppress).lower(), 'true', 'true')}, false)")
def false_positives_filtered(spark, sf):
    v = vulnerabilities(spark, sf)
    return V.filtered(V.detect_false_positives(v, v.filter("id % 50 = 7").select("id"))).agg(F.count("*").alias("kept"))


@query(
    f"SELECT id, CASE WHEN {_re('coalesce(file, ' + lit('') + ')', P.TEST_FILE)} THEN 0.4 WHEN {_re(_SNIP, P.EXAMPLE)} THEN 0.3 WHEN {_re(_SNIP, P.COMMENT, 'm')} THEN 0.85 END::DOUBLE AS confidence FROM ({VULNS})"
)
def false_positive_hints(spark, sf):
    return V.heuristic(vulnerabilities(spark, sf)).select("id", "hint.confidence")


def _word_share(words):
    n = " + ".join(f"(regexp_matches(code, {lit(chr(92) + 'b' + w + chr(92) + 'b')}, 'i'))::INT" for w in words)
    return f"least(1.0, 0.3 + ({n}) / {len(words)}.0 * 0.7)"


_HISTORY = (
    "CASE WHEN coalesce(type, '') = '' THEN 0.55 "
    + " ".join(f"WHEN name = '{k}' THEN {v}" for k, v in P.ACCURACY.items())
    + " "
    + " ".join(f"WHEN contains(name, '{k}') OR contains('{k}', name) THEN {v}" for k, v in P.ACCURACY.items())
    + " ELSE 0.55 END"
)
_SAFE_MAX = "greatest(0, " + ", ".join(f"CASE WHEN {_named('kind', t)} AND {_re('code', r)} THEN {c} ELSE 0 END" for r, t, c in P.SAFE) + ")"
_MODEL = (
    f"SELECT *, lower(coalesce(type, '')) AS kind, replace(lower(coalesce(type, '')), '-', '_') AS name, {_SNIP} || chr(10) || coalesce(report, '') AS code FROM ({VULNS})"
)
_PARTS = (
    "SELECT id, least(1.0, 0.5 + CASE WHEN len(patterns) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(indicators) > 0 THEN 0.1 ELSE 0 END + CASE WHEN cwe <> '' THEN 0.1 ELSE 0 END + CASE WHEN length(snippet) > 10 THEN 0.1 ELSE 0 END)::DOUBLE AS pattern, "
    f"(CASE WHEN safe > 0 THEN 1 - safe ELSE (CASE WHEN contains(kind, 'sql') THEN {_word_share(P.SQL_WORDS)} WHEN contains(kind, 'command') OR contains(kind, 'injection') THEN {_word_share(P.COMMAND_WORDS)} "
    f"WHEN contains(kind, 'xss') OR contains(kind, 'cross-site') THEN {_word_share(P.MARKUP_WORDS)} ELSE 0.6 END) * CASE WHEN {' OR '.join(_re(_SNIP, r) for r in P.LOGGING)} THEN 0.3 ELSE 1 END END)::DOUBLE AS context, "
    "(CASE WHEN coalesce(language, '') = '' THEN 0.5 WHEN lower(language) = lower(detected_language) THEN least(1.0, coalesce(language_confidence, 0.5) * 1.2) ELSE greatest(0.2, coalesce(language_confidence, 0.5) * 0.5) END)::DOUBLE AS language, "
    "(CASE WHEN coalesce(len(lines), 0) = 0 THEN 0.4 WHEN list_min(lines) <= 0 THEN 0.2 WHEN list_max(lines) - list_min(lines) > 100 THEN 0.3 WHEN length(report) > 0 THEN 0.8 ELSE 0.7 END)::DOUBLE AS lines, "
    f"({_HISTORY})::DOUBLE AS history FROM (SELECT *, {_SAFE_MAX}::DOUBLE AS safe FROM ({_MODEL}))"
)


@query(
    "SELECT id, round(pattern, 6) AS pattern, round(context, 6) AS context, language, lines, history, round(overall, 6) AS overall, CASE WHEN overall >= 0.75 THEN 'HIGH' WHEN overall >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, "
    "(context < 0.5)::INT + (language < 0.5)::INT + (lines < 0.5)::INT + (history < 0.5)::INT AS weak, context < 0.5 OR language < 0.5 OR lines < 0.5 OR history < 0.5 AS reduced "
    f"FROM (SELECT *, greatest(0, least(1, 0.15 * pattern + 0.35 * context + 0.15 * language + 0.15 * lines + 0.2 * history)) AS overall FROM ({_PARTS}))"
)
def confidence_parts(spark, sf):
    m = V.confidence_model(vulnerabilities(spark, sf), "report", "detected_language")
    said = V.confidence_description()
    reduced = F.startswith(said, F.lit("Confidence reduced due to: "))
    return m.select(
        "id", F.round("model.pattern", 6).alias("pattern"), F.round("model.context", 6).alias("context"), "model.language", "model.lines", "model.history", F.round("model.overall", 6).alias("overall"), "model.level",
        F.when(reduced, F.size(F.split(said, ", "))).otherwise(0).alias("weak"), reduced.alias("reduced"),
    )


_BOOSTS = (
    f"SELECT *, CASE WHEN known_exploited THEN base * 1.5 ELSE 0 END AS known, CASE WHEN epss >= 0.9 THEN base * 0.8 WHEN epss >= 0.5 THEN base * 0.3 ELSE 0 END AS likely, "
    "CASE WHEN cvss >= 9 OR epss >= 0.95 OR list_contains(list_transform(indicators, lambda x: regexp_matches(x, 'exploit|poc|metasploit|nuclei|burp', 'i')), true) THEN base * 0.5 ELSE 0 END AS exploit, "
    "CASE WHEN confidence >= 0.85 OR confidence_level = 'HIGH' THEN base * 0.2 ELSE 0 END AS sure, CASE WHEN business_logic THEN 5 ELSE 0 END + CASE WHEN architectural THEN 3 ELSE 0 END AS context "
    f"FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 10 END AS base FROM ({VULNS}))"
)
_SCORED = f"SELECT *, round(least(100, base + known + likely + exploit + sure + context), 6)::DOUBLE AS score FROM ({_BOOSTS})"
_LEVELED = f"SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 55 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ({_SCORED})"
_REASON = (
    "concat_ws(' | ', CASE WHEN known > 0 THEN CASE WHEN kev_date <> '' THEN 'CISA KEV: Active exploitation since ' || kev_date ELSE 'CISA KEV: Actively exploited in the wild' END END, "
    "CASE WHEN likely > 0 THEN 'EPSS: ' || floor(epss * 100 + 0.5)::BIGINT || '% exploitation probability' || CASE WHEN epss >= 0.9 THEN ' (very high)' ELSE '' END END, "
    "CASE WHEN exploit > 0 THEN 'Public exploit likely available' END, CASE WHEN severity = 'CRITICAL' THEN 'Critical severity requires immediate attention' END)"
)


@query(f"SELECT id, score, level, nullif({_REASON}, '') AS reason FROM ({_LEVELED})")
def priority_score(spark, sf):
    return V.prioritize(vulnerabilities(spark, sf)).select("id", "priority.score", "priority.level", "priority.reason")


@query(
    f"SELECT id, (CASE level WHEN 'CRITICAL' THEN '🚨' WHEN 'HIGH' THEN '🔴' WHEN 'MEDIUM' THEN '🟠' ELSE '🟢' END) || ' Priority: ' || floor(score + 0.5)::BIGINT || '/100' AS badge, "
    "concat_ws(chr(10), '**Priority Score**: ' || floor(score + 0.5)::BIGINT || '/100 (' || level || ')', '', '**Score Breakdown**:', '- Base Severity (' || severity || '): +' || base, "
    "CASE WHEN known > 0 THEN '- CISA KEV (Known Exploited): +' || floor(known + 0.5)::BIGINT || ' 🚨' END, CASE WHEN likely > 0 THEN '- EPSS Score (' || floor(epss * 100 + 0.5)::BIGINT || '%): +' || floor(likely + 0.5)::BIGINT || ' ⚡' END, "
    "CASE WHEN exploit > 0 THEN '- Public Exploit Available: +' || floor(exploit + 0.5)::BIGINT END, CASE WHEN sure > 0 THEN '- High Confidence: +' || floor(sure + 0.5)::BIGINT END, CASE WHEN context > 0 THEN '- Business Context: +' || context END, "
    f"CASE WHEN r <> '' THEN '' END, CASE WHEN r <> '' THEN '**Urgency**: ' || r END) AS explanation FROM (SELECT *, {_REASON} AS r FROM ({_LEVELED}))"
)
def priority_explained(spark, sf):
    return V.prioritize(vulnerabilities(spark, sf)).select("id", V.priority_badge().alias("badge"), F.array_join(V.priority_explanation(), "\n").alias("explanation"))


@query(f"SELECT id FROM ({_LEVELED}) WHERE level = 'CRITICAL' OR known > 0 OR epss >= 0.9")
def immediate_action(spark, sf):
    return V.immediate_action(V.prioritize(vulnerabilities(spark, sf))).select("id")


@query(f"SELECT id, score FROM ({_LEVELED}) ORDER BY score DESC, id LIMIT 5")
def top_priority(spark, sf):
    return V.top_priority(V.prioritize(vulnerabilities(spark, sf))).select("id", "priority.score")


@query(
    "SELECT report, count(*) AS total, count(*) FILTER (known > 0) AS known, count(*) FILTER (likely > 0) AS likely, count(*) FILTER (exploit > 0) AS exploit, count(*) FILTER (level = 'CRITICAL') AS critical, "
    f"count(*) FILTER (level = 'HIGH') AS high, floor(avg(score) + 0.5)::BIGINT AS mean_score FROM ({_LEVELED}) GROUP BY report"
)
def intelligence_summary(spark, sf):
    return V.priority_summary(V.prioritize(vulnerabilities(spark, sf)), "report")


_SUSPECT = (
    "CASE WHEN " + " OR ".join(f"({_re(_SNIP, r)} AND {_named(_KIND, t)}" + ("" if g == "any" else f" AND {_LANG} = '{g}'") + ")" for r, t, g in P.MISCLASSIFIED) + " THEN 1.0 ELSE 0 END"
    + " + CASE WHEN confidence >= 0.9 AND (" + " OR ".join(_re(_SNIP, r) for r in P.SUSPICIOUS) + ") THEN 0.5 ELSE 0 END"
)
_QUALITY = (
    "SELECT report, count(*) AS n, CASE WHEN coalesce(max(detected_language), 'unknown') IN ('', 'unknown') THEN 0.2 WHEN count(language_confidence) = 0 THEN 0.5 ELSE greatest(0, avg(language_confidence) - CASE WHEN count(DISTINCT nullif(language, '')) > 2 THEN 0.2 ELSE 0 END) END AS language, "
    "CASE WHEN count(confidence) < 2 THEN 0.7 ELSE 1 - least(1, var_pop(confidence) / 0.1) END AS consistency, "
    f"least(1, sum({_SUSPECT}) / count(*)) AS risk, "
    "CASE WHEN count(*) FILTER (len(lines) > 0) = 0 THEN 0.3 ELSE count(*) FILTER (len(lines) > 0 AND list_min(lines) > 0 AND list_max(lines) < 100000 AND list_max(lines) - list_min(lines) < 50) / count(*) FILTER (len(lines) > 0) END AS lines, "
    "avg(least(1.0, 0.5 + CASE WHEN len(patterns) > 0 THEN 0.15 ELSE 0 END + CASE WHEN cwe <> '' THEN 0.1 ELSE 0 END + CASE WHEN owasp <> '' THEN 0.1 ELSE 0 END + CASE WHEN vulnerable_code <> '' AND secure_code <> '' THEN 0.15 ELSE 0 END + CASE WHEN length(impact) > 20 THEN 0.1 ELSE 0 END)::DOUBLE) AS pattern "
    f"FROM ({VULNS}) GROUP BY report"
)
_GATED = f"SELECT *, language * 0.2 + consistency * 0.15 + (1 - risk) * 0.3 + lines * 0.15 + pattern * 0.2 AS accuracy FROM ({_QUALITY})"


@query(
    "SELECT report, n, round(language, 6)::DOUBLE AS language, round(consistency, 6)::DOUBLE AS consistency, round(risk, 6)::DOUBLE AS risk, round(lines, 6)::DOUBLE AS lines, round(pattern, 6)::DOUBLE AS pattern, round(accuracy, 6)::DOUBLE AS accuracy, "
    "accuracy >= 0.65 AND language >= 0.5 AND risk <= 0.35 AS shown, (accuracy < 0.65)::INT + (language < 0.5)::INT + (risk > 0.35)::INT + (lines < 0.5)::INT AS n_issues "
    f"FROM ({_GATED})"
)
def quality_gate(spark, sf):
    g = V.quality_gate(V.report_quality(vulnerabilities(spark, sf)))
    parts = ("language", "consistency", "risk", "lines", "pattern", "accuracy")
    return g.select("report", "n", *(F.round(c, 6).cast("double").alias(c) for c in parts), "shown", F.size("issues").alias("n_issues"))
