"""Report documents over findings, as ordered rows of text: one definition for a table, a file or a folder.

A document is a DataFrame (part, section, place, step, seq, text), in the order of these: the header is part 0; a
group of findings has the place of its first one, and opens at step 0, has its findings at 1 and ends at 2. No document is gathered into one row or task; ``write`` sorts by range, so the files, in their order, are the text.

Findings have, by these names: seq, id, rule_id, rule_name, severity, category, message, description, file, line,
column, end_line, end_column, confidence, cwe and owasp (arrays), fix_available, suggestion, snippet, cvss. What is
missing counts as null. ``seq`` gives their order; without it the order is by file, line, column and rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import severity, text

# Extensions and media types of the formats.
EXTENSION = {"sarif": "sarif", "html": "html", "json": "json", "markdown": "md", "csv": "csv", "junit": "xml", "sonarqube": "json", "checkstyle": "xml", "codeclimate": "json"}
MEDIA_TYPE = {
    "sarif": "application/json", "html": "text/html", "json": "application/json", "markdown": "text/markdown", "csv": "text/csv",
    "junit": "application/xml", "sonarqube": "application/json", "checkstyle": "application/xml", "codeclimate": "application/json",
}
CSV_HEADER = ("ID", "Rule ID", "Rule Name", "Severity", "Category", "Message", "File", "Line", "Column", "Confidence", "CWE", "OWASP", "Fix Available")
EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢", "info": "ℹ️"}

_COLUMNS = {
    "id": "string", "rule_id": "string", "rule_name": "string", "severity": "string", "category": "string", "message": "string", "description": "string", "file": "string", "line": "long", "column": "long",
    "end_line": "long", "end_column": "long", "confidence": "double", "cwe": "array<string>", "owasp": "array<string>", "fix_available": "boolean", "suggestion": "string", "snippet": "string", "cvss": "double",
}


@dataclass(frozen=True)
class Meta:
    """What a report says of itself; nothing in it is read from a clock."""

    title: str = "Report"
    generated_at: str = "1970-01-01T00:00:00Z"
    name: str = "siltworks"
    version: str = "1.0.0"
    repository: str | None = None
    branch: str | None = None
    score: int | None = None
    grade: str | None = None
    analysis_ms: int = 0
    snippets: bool = False
    fixes: bool = False
    group_by: str = "severity"


def extension(form: str) -> str:
    return EXTENSION.get(form, "txt")


def media_type(form: str) -> str:
    return MEDIA_TYPE.get(form, "text/plain")


def extension_of(form: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSION.items() for x in kv)), form), F.lit("txt"))


def media_type_of(form: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA_TYPE.items() for x in kv)), form), F.lit("text/plain"))


def canonical(findings: DataFrame) -> DataFrame:
    """All columns by name and type; ``column`` may be called col, and the rule's name defaults to its id."""
    df = findings.withColumnRenamed("col", "column") if "col" in findings.columns and "column" not in findings.columns else findings
    has = set(df.columns)
    out = df.select(*(["seq"] if "seq" in has else []), *((F.col(f"`{n}`") if n in has else F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS.items()))
    if "seq" not in has:
        order = F.struct("file", "line", "column", "rule_id", "message")
        out = out.withColumn("seq", order)
    return out.withColumns({"rule_name": F.coalesce("rule_name", "rule_id"), "column": F.coalesce("column", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.7)), "severity": F.coalesce("severity", F.lit("medium")), "category": F.coalesce("category", F.lit("unknown"))})


def select(findings: DataFrame, min_severity: str | None = None, max_issues: int | None = None, sort_by: str | None = None) -> DataFrame:
    """The findings a report is to have: of a least severity, the first so many by severity, file, line or confidence."""
    df = canonical(findings)
    if min_severity:
        df = df.filter(severity.at_least(F.lower("severity"), min_severity))
    order = {"severity": [severity.rank(F.lower("severity")), "seq"], "file": ["file", "seq"], "line": ["line", "seq"], "confidence": [F.desc("confidence"), "seq"]}.get(sort_by or "", ["seq"])
    return df.orderBy(*order).limit(max_issues) if max_issues is not None else df


def summary(findings: DataFrame) -> DataFrame:
    """One row: total and the count of each severity."""
    low = F.lower("severity")
    return findings.agg(F.count("*").alias("total"), *(F.count_if(low == s).alias(s) for s in severity.ORDER))


def _rows(df: DataFrame, part: int, body: Column, section: Column | None = None, place: Column | None = None, step: int = 1, seq: Column | None = None) -> DataFrame:
    none = lambda: F.lit(None)
    return df.select(F.lit(part).alias("part"), (F.lit(0) if section is None else section).cast("int").alias("section"), (none() if place is None else place).alias("place"), F.lit(step).alias("step"), (none() if seq is None else seq).alias("seq"), body.alias("text"))


def _all(f: DataFrame, *parts: DataFrame) -> DataFrame:
    """The parts as one document; places and positions have the type of the findings' ``seq``."""
    kind = f.schema["seq"].dataType
    typed = [p.withColumns({c: F.col(c).cast(kind) for c in ("place", "seq")}) for p in parts]
    return reduce(DataFrame.unionByName, typed)


def _one(findings: DataFrame, part: int, body: Column) -> DataFrame:
    """A row of the document made of the summary."""
    return _rows(summary(findings), part, body)


def _joined(col: str, mark: str) -> Column:
    return F.coalesce(F.array_join(col, mark), F.lit(""))


def _s(col: str) -> Column:
    return F.col(col).cast("string")


def _number(col: str) -> Column:
    """A number's shortest text: whole ones have no fraction."""
    return F.regexp_replace(_s(col), r"\.0$", "")


def csv(f: DataFrame, meta: Meta) -> DataFrame:
    fields = [_s("id"), F.col("rule_id"), text.escape_csv(F.col("rule_name")), F.col("severity"), F.col("category"), text.escape_csv(F.col("message")), text.escape_csv(F.col("file")), _s("line"), _s("column"), _number("confidence"), _joined("cwe", ";"), _joined("owasp", ";"), F.when(F.col("fix_available"), "Yes").otherwise("No")]
    body = F.concat_ws(",", *(F.coalesce(x, F.lit("")) for x in fields))
    return _all(f, _one(f, 0, F.lit(",".join(CSV_HEADER))), _rows(f, 1, body, seq=F.col("seq")))


def failed(col: str = "severity") -> Column:
    return F.lower(col).isin("critical", "high")


def _heads(f: DataFrame, key: str, *more: Column) -> DataFrame:
    """One row a group: how many findings it has, and the first of them."""
    return f.groupBy(key).agg(F.count("*").alias("n"), F.min("seq").alias("first"), *more)


#: Findings of a group, beyond which they are not sent to one task.
LARGE = 50_000


def _with_first(f: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Findings with the first of their group. The heads of large groups are broadcast, at most one for ``LARGE`` findings, so that
    no task gets a group of any size; those of the others, which may be as many as findings, are joined by key."""
    named = heads.select(F.col(key).alias("_k"), "first", "n")
    large, small = F.broadcast(named.filter(F.col("n") > LARGE)), named.filter(F.col("n") <= LARGE).hint("merge")
    on = F.col(key).eqNullSafe(F.col("_k"))
    rest = f.join(large, on, "left_anti").join(small, on)
    return f.join(large, on).unionByName(rest).drop("_k", "n")


def junit(f: DataFrame, meta: Meta) -> DataFrame:
    """A suite for each file, in the order of first findings; a failure where critical or high."""
    heads = _heads(f, "file", F.count_if(failed()).alias("failures"))
    name = text.escape_xml(F.coalesce("file", F.lit("")))
    top = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="Security Analysis" tests="'), _s("total"), F.lit('" failures="'), (F.col("critical") + F.col("high")).cast("string"), F.lit(f'" errors="0" time="{meta.analysis_ms / 1000:g}">'))
    open_ = F.concat(F.lit('  <testsuite name="'), name, F.lit('" tests="'), _s("n"), F.lit('" failures="'), _s("failures"), F.lit('" errors="0">'))
    snippet = F.when(F.length("snippet") > 0, F.concat(F.lit("\n"), F.lit("\n"), text.escape_xml(F.col("snippet")))).otherwise("")
    failure = F.concat(F.lit('\n      <failure message="'), text.escape_xml(F.col("message")), F.lit('" type="'), F.col("severity"), F.lit('">\nLocation: '), F.col("file"), F.lit(":"), _s("line"), F.lit(":"), _s("column"), snippet, F.lit("\n      </failure>"))
    case = F.concat(F.lit('    <testcase name="'), text.escape_xml(F.col("rule_name")), F.lit('" classname="'), name, F.lit('">'), F.when(failed(), failure).otherwise(""), F.lit("\n    </testcase>"))
    first = F.col("first")
    cases = _rows(_with_first(f, heads, "file"), 1, case, place=first, seq=F.col("seq"))
    return _all(f, _one(f, 0, top), _rows(heads, 1, open_, place=first, step=0), cases, _rows(heads, 1, F.lit("  </testsuite>"), place=first, step=2), _one(f, 2, F.lit("</testsuites>")))


def markdown(f: DataFrame, meta: Meta) -> DataFrame:
    """A section for each severity that has findings, in rank order."""
    head = [f"# {meta.title}", "", f"> Generated on {meta.generated_at}", ""]
    if meta.repository:
        head += [f"**Repository:** {meta.repository}", *([f"**Branch:** {meta.branch}"] if meta.branch else []), ""]
    head += ["## Summary", "", "| Severity | Count |", "|----------|-------|"]
    rows = [F.concat(F.lit(f"| {EMOJI[s]} {s.capitalize()} | "), _s(s), F.lit(" |")) for s in severity.ORDER]
    tail = ["", *([f"**Security Score:** {meta.score}/100 {f'({meta.grade})' if meta.grade else ''}", ""] if meta.score is not None else [])]
    top = F.concat_ws("\n", *map(F.lit, head), *rows, F.concat(F.lit("| **Total** | **"), _s("total"), F.lit("** |")), *map(F.lit, tail))
    low = F.lower("severity")
    known = f.filter(low.isin(*severity.ORDER)).withColumn("_low", low)
    label = severity.mapped(F.col("_low"), {s: f"## {EMOJI[s]} {s.capitalize()} Issues (" for s in severity.ORDER}, "")
    heads = known.groupBy("_low").agg(F.count("*").alias("n"))
    snippet = F.when(F.lit(meta.snippets) & (F.length("snippet") > 0), F.concat(F.lit("```\n"), F.col("snippet"), F.lit("\n```\n\n"))).otherwise("")
    note = F.when(F.length("suggestion") > 0, F.concat(F.lit("**💡 Suggestion:** "), F.col("suggestion"), F.lit("\n\n"))).otherwise("")
    weak = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"**{name}:** "), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("### "), F.col("rule_name"), F.lit("\n\n**File:** `"), F.col("file"), F.lit(":"), _s("line"), F.lit(":"), _s("column"), F.lit("`\n\n"), F.col("message"), F.lit("\n\n"), snippet, note, weak("cwe", "CWE"), weak("owasp", "OWASP"), F.lit("\n---\n"))
    rank = severity.rank(F.col("_low"))
    return _all(f, _one(f, 0, top), _rows(heads, 1, F.concat(label, _s("n"), F.lit(")\n")), rank, step=0), _rows(known, 1, body, rank, seq=F.col("seq")), _one(f, 2, F.lit(f"*Generated by {meta.name} v{meta.version}*")))


def location_hash() -> Column:
    """Marks a finding's place and rule."""
    return text.poly_hash(F.concat_ws(":", "file", _s("line"), "rule_id"))


def issue_fingerprint() -> Column:
    """Marks a finding's rule, place and message, 32 digits."""
    mark = text.poly_hash(F.concat_ws(":", "rule_id", "file", _s("line"), "message"))
    return F.lpad(mark, 32, "0")


def _listed(f: DataFrame, part: int, body: Column) -> DataFrame:
    """Items of a JSON list: a comma leads each but the first."""
    first = f.agg(F.min("seq").alias("_first"))  # one row
    rows = f.join(F.broadcast(first))
    return _rows(rows, part, F.concat(F.when(F.col("seq") == F.col("_first"), "").otherwise(","), body), seq=F.col("seq"))


def code_climate(f: DataFrame, meta: Meta) -> DataFrame:
    level = severity.mapped(F.lower("severity"), severity.CLIMATE, "minor")
    body = F.struct(
        F.lit("issue").alias("type"), F.col("rule_id").alias("check_name"), F.col("message").alias("description"), F.struct(F.coalesce(F.nullif("description", F.lit("")), "message").alias("body")).alias("content"),
        F.array(F.when(F.col("category") == "security", "Security").otherwise("Bug Risk")).alias("categories"), level.alias("severity"), issue_fingerprint().alias("fingerprint"),
        F.struct(F.col("file").alias("path"), F.struct(F.col("line").alias("begin"), F.coalesce(F.nullif("end_line", F.lit(0)), "line").alias("end")).alias("lines")).alias("location"),
    )
    return _all(f, _one(f, 0, F.lit("[")), _listed(f, 1, F.to_json(body)), _one(f, 2, F.lit("]")))


def sarif_rules(f: DataFrame, meta: Meta) -> DataFrame:
    """rule_id, rule_index (by first finding), seq of that finding and the rule's JSON."""
    first = f.groupBy("rule_id").agg(F.min_by(F.struct(*(c for c in f.columns if c != "rule_id")), "seq").alias("r")).select("rule_id", "r.*")
    level = severity.mapped(F.lower("severity"), severity.SARIF, "warning")
    body = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.struct(F.col("rule_name").alias("text")).alias("shortDescription"), F.struct(F.coalesce(F.nullif("description", F.lit("")), "message").alias("text")).alias("fullDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"),
        F.struct(F.col("category"), F.when(F.col("cwe").isNotNull(), F.concat("cwe", F.coalesce("owasp", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("tags"), _number("cvss").alias("security_severity")).alias("properties"),
    )
    # one row a rule: the number of rules bounds this sort
    return first.select("rule_id", "seq", F.to_json(body).alias("json")).withColumn("rule_index", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long"))


def sarif_results(f: DataFrame, meta: Meta) -> DataFrame:
    """seq, rule_id, rule_index, level and the result's JSON."""
    rules = sarif_rules(f, meta).select(F.col("rule_id").alias("_r"), "rule_index")
    level = severity.mapped(F.lower("severity"), severity.SARIF, "warning")
    on = lambda test, x: F.when(test, x)
    region = F.struct(
        F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.coalesce(F.nullif("end_line", F.lit(0)), "line").alias("endLine"), F.coalesce(F.nullif("end_column", F.lit(0)), F.col("column") + 1).alias("endColumn"),
        on(F.lit(meta.snippets) & (F.length("snippet") > 0), F.struct(F.col("snippet").alias("text"))).alias("snippet"),
    )
    body = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(location_hash().alias("primaryLocationLineHash")).alias("partialFingerprints"),
        on(F.lit(meta.fixes) & F.col("fix_available") & (F.length("suggestion") > 0), F.array(F.struct(F.struct(F.col("suggestion").alias("text")).alias("description")))).alias("fixes"),
        F.struct("confidence", "category", "cwe", "owasp").alias("properties"),
    )
    return f.join(rules, F.col("rule_id") == F.col("_r")).select("seq", "rule_id", "rule_index", level.alias("level"), F.to_json(body).alias("json"))


def sarif(f: DataFrame, meta: Meta) -> DataFrame:
    rules = sarif_rules(f, meta)
    top = f'{{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{meta.name}","version":"{meta.version}","semanticVersion":"{meta.version}","rules":['
    middle = f']}}}},"invocations":[{{"executionSuccessful":true,"endTimeUtc":"{meta.generated_at}"}}],"results":['
    end = f'],"automationDetails":{{"id":"{meta.name}/{meta.repository or "unknown"}"}}}}]}}'
    return _all(f, _one(f, 0, F.lit(top)), _listed(rules, 1, F.col("json")), _one(f, 2, F.lit(middle)), _listed(sarif_results(f, meta), 3, F.col("json")), _one(f, 4, F.lit(end)))


def json(f: DataFrame, meta: Meta) -> DataFrame:
    """The findings themselves, with the summary."""
    counts = F.to_json(F.struct(F.col("total").alias("totalIssues"), *(F.col(s).alias(f"{s}Count") for s in severity.ORDER)))
    top = F.concat(F.lit(f'{{"metadata":{{"title":"{meta.title}","generatedAt":"{meta.generated_at}"}},"summary":'), counts, F.lit(',"issues":['))
    body = F.to_json(F.struct(*_COLUMNS))
    return _all(f, _one(f, 0, top), _listed(f, 1, body), _one(f, 2, F.lit("]}")))


def score_class(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def html(f: DataFrame, meta: Meta) -> DataFrame:
    """A page: counts, then the findings grouped by severity, file, category or rule, groups by their first finding."""
    by = {"file": "file", "category": "category", "rule": "rule_id"}.get(meta.group_by, "severity")
    e = lambda c: text.escape_html(F.coalesce(F.col(c), F.lit("")))
    heads = _heads(f, by)
    card = lambda s: F.concat(F.lit(f'<div class="card {s}"><b>'), _s(s), F.lit(f"</b> {s.capitalize()}</div>"))
    name = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")
    top = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>{name(meta.title)}</title></head>\n<body>\n<h1>{name(meta.title)}</h1>\n<p>{name(meta.generated_at)}</p>\n'), *map(card, severity.ORDER), F.lit('<div class="card"><b>'), _s("total"), F.lit("</b> Total</div>"))
    snippet = F.when(F.lit(meta.snippets) & (F.length("snippet") > 0), F.concat(F.lit("<pre>"), e("snippet"), F.lit("</pre>"))).otherwise("")
    note = F.when(F.length("suggestion") > 0, F.concat(F.lit("<p>💡 "), e("suggestion"), F.lit("</p>"))).otherwise("")
    extra = F.concat(F.lit("<small>"), (F.floor(F.col("confidence") * 100 + 0.5)).cast("string"), F.lit("%"), F.when(F.size("cwe") > 0, F.concat(F.lit(" "), F.array_join("cwe", ", "))).otherwise(""), F.when(F.col("fix_available"), " 🔧").otherwise(""), F.lit("</small>"))
    body = F.concat(F.lit('<div class="issue"><b>'), e("rule_name"), F.lit('</b> <i class="'), F.lower("severity"), F.lit('">'), F.col("severity"), F.lit("</i> <i>"), e("category"), F.lit("</i><p>📁 "), e("file"), F.lit(":"), _s("line"), F.lit(":"), _s("column"), F.lit("</p><p>"), e("message"), F.lit("</p>"), snippet, note, extra, F.lit("</div>"))
    first = F.col("first")
    group = F.concat(F.lit("<section><h3>"), e(by), F.lit(" ("), _s("n"), F.lit(")</h3>"))
    issues = _rows(_with_first(f, heads, by), 1, body, place=first, seq=F.col("seq"))
    return _all(f, _one(f, 0, top), _rows(heads, 1, group, place=first, step=0), issues, _rows(heads, 1, F.lit("</section>"), place=first, step=2), _one(f, 2, F.lit("</body>\n</html>")))


FORMATS = {"csv": csv, "codeclimate": code_climate, "junit": junit, "markdown": markdown, "sarif": sarif, "json": json, "html": html}


def document(findings: DataFrame, form: str, meta: Meta | None = None) -> DataFrame:
    """part, section, place, step, seq, text of a report."""
    if form not in FORMATS:
        raise ValueError(f"Unsupported report format: {form}")
    return FORMATS[form](canonical(findings), meta or Meta())


def write(findings: DataFrame, form: str, path: str, meta: Meta | None = None) -> None:
    """The document's text as files below ``path``, to be read in the order of their names."""
    document(findings, form, meta).orderBy("part", "section", "place", "step", "seq").select("text").write.text(path)
