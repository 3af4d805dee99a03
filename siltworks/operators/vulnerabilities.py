"""Vulnerabilities: false positives, confidence, priority, and the quality gate of a report.

Columns that the operators read, by these names, the others passing through: id, report, type, title, language,
language_confidence, detected_language, snippet, file, lines (array of int), severity, confidence, confidence_level,
patterns, indicators (arrays of string), cwe, owasp, vulnerable_code, secure_code, impact, known_exploited, kev_date,
epss, cvss, business_logic, architectural. All rules are literals of one projection: nothing is shuffled but the
gate's aggregation by report and the join with suppressed ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.scoring import half_up
from siltworks.plans import vulnerabilities as P


def text_or(*cols: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def has(col: Column) -> Column:
    return F.coalesce(F.length(col) > 0, F.lit(False))


def filled(col: Column) -> Column:
    return F.coalesce(F.size(col) > 0, F.lit(False))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def named(kind: Column, types) -> Column:
    """The lower-case kind contains one of the types, in any case."""
    return any_of(F.contains(kind, F.lit(t)) for t in dict.fromkeys(x.lower() for x in types))


def found(code: Column, regex: str, flags: str = "i") -> Column:
    return code.rlike(f"(?{flags}){regex}")


_KIND = lambda: F.lower(text_or(F.col("type"), F.col("title")))
_SNIPPET = lambda: F.coalesce(F.col("snippet"), F.lit(""))
_LANGUAGE = lambda: F.lower(F.coalesce(F.col("language"), F.lit("")))


def detect_false_positives(vulns: DataFrame, suppressed: DataFrame | None = None, code: str | None = None) -> DataFrame:
    """Adds ``fp``: pattern, confidence, reason, classification, suppressed; null where it is none.

    Ids of ``suppressed`` (column id) come first, then the first pattern that fits, then a comment in the snippet
    unless the file is a test's or the code an example. ``code`` is a column with more of the code.
    """
    snippet = _SNIPPET()
    body = snippet if code is None else F.when(has(F.col(code)), F.concat(snippet, F.lit("\n"), F.col(code))).otherwise(snippet)
    kind, language = _KIND(), _LANGUAGE()

    def result(pattern, confidence, reason, classification, suppress):
        return F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in (("pattern", pattern, "string"), ("confidence", confidence, "double"), ("reason", reason, "string"), ("classification", classification, "string"), ("suppressed", suppress, "boolean"))))

    rows = vulns
    chain = F
    if suppressed is not None:
        rows = rows.join(suppressed.select("id").distinct().withColumn("_user", F.lit(True)), "id", "left")
        chain = chain.when(F.col("_user"), result("user", 1.0, "User suppressed", None, True))
    for p in P.FALSE_POSITIVES:
        test = named(kind, p.types) & found(body, p.regex)
        if "any" not in p.languages:
            test = test & language.isin(*p.languages)
        if p.context:
            test = test & found(body, p.context)
        chain = chain.when(test, result(p.id, p.confidence, p.reason, p.classification, p.suppress))
    early = found(F.coalesce(F.col("file"), F.lit("")), P.TEST_FILE) | found(body, P.EXAMPLE)
    chain = chain.when(~early & found(snippet, P.COMMENT, "m"), result("comment", 0.85, "Vulnerability in commented code", None, True))
    out = rows.withColumn("fp", chain)
    return out.drop("_user") if suppressed is not None else out


def heuristic(vulns: DataFrame) -> DataFrame:
    """Adds ``hint``: what speaks against a finding without making it false (test file .4, example .3, comment .85)."""
    snippet = _SNIPPET()
    hint = lambda c, r, f: F.struct(F.lit(c).alias("confidence"), F.lit(r).alias("reason"), F.lit(f).alias("false_positive"))
    return vulns.withColumn(
        "hint",
        F.when(found(F.coalesce(F.col("file"), F.lit("")), P.TEST_FILE), hint(0.4, "In test file - may be intentional vulnerable example", False))
        .when(found(snippet, P.EXAMPLE), hint(0.3, "Appears to be example/documentation code", False))
        .when(found(snippet, P.COMMENT, "m"), hint(0.85, "Vulnerability in commented code", True)),
    )


def partition(detected: DataFrame) -> DataFrame:
    """Adds ``status``: removed, warned (kept with a warning) or kept."""
    return detected.withColumn("status", F.when(F.col("fp.suppressed"), "removed").when(F.col("fp").isNotNull(), "warned").otherwise("kept"))


def filtered(detected: DataFrame) -> DataFrame:
    """What remains: kept and warned."""
    return partition(detected).filter("status != 'removed'")


def patterns_for(kind: str) -> list[P.FalsePositive]:
    return [p for p in P.FALSE_POSITIVES if any(t.lower() in kind.lower() for t in p.types)]


def pattern_by_id(name: str) -> P.FalsePositive | None:
    return next((p for p in P.FALSE_POSITIVES if p.id == name), None)


def _share(code: Column, words) -> Column:
    n = reduce(lambda a, w: a + F.when(found(code, rf"\b{w}\b"), 1).otherwise(0), words, F.lit(0))
    return F.least(F.lit(1.0), F.lit(0.3) + n / F.lit(len(words)) * 0.7)


def confidence_model(vulns: DataFrame, surrounding: str | None = None, context_language: str | None = None) -> DataFrame:
    """Adds ``model``: the five parts, their weighted sum ``overall`` and its ``level``."""
    kind = F.lower(F.coalesce(F.col("type"), F.lit("")))
    snippet = _SNIPPET()
    around = F.coalesce(F.col(surrounding), F.lit("")) if surrounding else F.lit("")
    code = F.concat(snippet, F.lit("\n"), around)
    pattern = F.least(F.lit(1.0), 0.5 + F.when(filled(F.col("patterns")), 0.2).otherwise(0.0) + F.when(filled(F.col("indicators")), 0.1).otherwise(0.0) + F.when(has(F.col("cwe")), 0.1).otherwise(0.0) + F.when(F.length("snippet") > 10, 0.1).otherwise(0.0))
    safe = F.greatest(F.lit(0.0), *(F.when(named(kind, types) & found(code, regex), cut).otherwise(0.0) for regex, types, cut in P.SAFE))
    base = (
        F.when(F.contains(kind, F.lit("sql")), _share(code, P.SQL_WORDS))
        .when(F.contains(kind, F.lit("command")) | F.contains(kind, F.lit("injection")), _share(code, P.COMMAND_WORDS))
        .when(F.contains(kind, F.lit("xss")) | F.contains(kind, F.lit("cross-site")), _share(code, P.MARKUP_WORDS))
        .otherwise(0.6)
    )
    logging = any_of(found(snippet, r) for r in P.LOGGING)
    context = F.when(safe > 0, 1 - safe).otherwise(base * F.when(logging, 0.3).otherwise(1.0))
    sure = F.coalesce(F.col("language_confidence"), F.lit(0.5))
    same = F.lower("language") == F.lower(F.col(context_language)) if context_language else F.lit(False)
    language = F.when(~has(F.col("language")), 0.5).when(same, F.least(F.lit(1.0), sure * 1.2)).otherwise(F.greatest(F.lit(0.2), sure * 0.5))
    spread = F.array_max("lines") - F.array_min("lines")
    lines = F.when(~filled(F.col("lines")), 0.4).when(F.array_min("lines") <= 0, 0.2).when(spread > 100, 0.3).when(has(around), 0.8).otherwise(0.7)
    name = F.translate(kind, "-", "_")
    history = F.when(~has(F.col("type")), P.ACCURACY["default"])
    for key, value in P.ACCURACY.items():
        history = history.when(name == key, value)
    for key, value in P.ACCURACY.items():
        history = history.when(F.contains(name, F.lit(key)) | F.contains(F.lit(key), name), value)
    parts = {"pattern": pattern, "context": context, "language": language, "lines": lines, "history": history.otherwise(P.ACCURACY["default"])}
    parts = {k: v.cast("double") for k, v in parts.items()}
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, (parts[k] * w for k, w in P.WEIGHTS.items()))))
    out = vulns.withColumn("model", F.struct(*(v.alias(k) for k, v in parts.items()), overall.alias("overall")))
    return out.withColumn("model", F.col("model").withField("level", confidence_level(F.col("model.overall"))))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def confidence_description(model: str = "model") -> Column:
    """What weakens the confidence, or that nothing does."""
    weak = F.concat_ws(
        ", ",
        F.when(F.col(f"{model}.context") < 0.5, "code context may not match vulnerability type"),
        F.when(F.col(f"{model}.language") < 0.5, "language detection uncertainty"),
        F.when(F.col(f"{model}.lines") < 0.5, "line number accuracy may be low"),
        F.when(F.col(f"{model}.history") < 0.5, "this pattern type has higher false positive rates"),
    )
    return F.when(weak == "", "High confidence finding with strong supporting evidence").otherwise(F.concat(F.lit("Confidence reduced due to: "), weak))


def prioritize(vulns: DataFrame) -> DataFrame:
    """Adds ``priority``: base, known, likely, exploit, sure, context, score (at most 100), level and reason (or null)."""
    base = F.when(F.col("severity") == "CRITICAL", 40.0).when(F.col("severity") == "HIGH", 30.0).when(F.col("severity") == "MEDIUM", 20.0).otherwise(10.0)
    words = F.exists(F.col("indicators"), lambda e: found(e, "|".join(P.EXPLOIT_WORDS)))
    exploited = F.coalesce(F.col("cvss") >= 9, F.lit(False)) | F.coalesce(F.col("epss") >= 0.95, F.lit(False)) | F.coalesce(words, F.lit(False))
    sure = F.coalesce(F.col("confidence") >= 0.85, F.lit(False)) | F.coalesce(F.col("confidence_level") == "HIGH", F.lit(False))
    part = lambda test, x: F.when(test, x).otherwise(0.0)
    rows = vulns.withColumn(
        "priority",
        F.struct(
            base.alias("base"),
            part(F.col("known_exploited"), base * 1.5).alias("known"),
            F.when(F.col("epss") >= 0.9, base * 0.8).when(F.col("epss") >= 0.5, base * 0.3).otherwise(0.0).alias("likely"),
            part(exploited, base * 0.5).alias("exploit"),
            part(sure, base * 0.2).alias("sure"),
            (part(F.col("business_logic"), F.lit(5.0)) + part(F.col("architectural"), F.lit(3.0))).alias("context"),
        ),
    )
    p = lambda x: F.col(f"priority.{x}")
    score = F.round(F.least(F.lit(100.0), p("base") + p("known") + p("likely") + p("exploit") + p("sure") + p("context")), 6)
    percent = half_up(F.col("epss") * 100).cast("string")
    reason = F.concat_ws(
        " | ",
        F.when(p("known") > 0, F.when(has(F.col("kev_date")), F.concat(F.lit("CISA KEV: Active exploitation since "), F.col("kev_date"))).otherwise("CISA KEV: Actively exploited in the wild")),
        F.when(p("likely") > 0, F.concat(F.lit("EPSS: "), percent, F.lit("% exploitation probability"), F.when(F.col("epss") >= 0.9, " (very high)").otherwise(""))),
        F.when(p("exploit") > 0, "Public exploit likely available"),
        F.when(F.col("severity") == "CRITICAL", "Critical severity requires immediate attention"),
    )
    level = F.when(score >= 80, "CRITICAL").when(score >= 55, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    return rows.withColumn("priority", F.col("priority").withField("score", score).withField("level", level).withField("reason", F.nullif(reason, F.lit(""))))


def immediate_action(prioritized: DataFrame) -> DataFrame:
    return prioritized.filter((F.col("priority.level") == "CRITICAL") | (F.col("priority.known") > 0) | ((F.col("priority.likely") > 0) & (F.col("epss") >= 0.9)))


def top_priority(prioritized: DataFrame, n: int = 5) -> DataFrame:
    return prioritized.orderBy(F.desc("priority.score"), "id").limit(n)


def priority_summary(prioritized: DataFrame, *keys: str) -> DataFrame:
    """Counts by boost and level, and the mean score, halves up."""
    return prioritized.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("priority.known") > 0).alias("known"),
        F.count_if(F.col("priority.likely") > 0).alias("likely"),
        F.count_if(F.col("priority.exploit") > 0).alias("exploit"),
        F.count_if(F.col("priority.level") == "CRITICAL").alias("critical"),
        F.count_if(F.col("priority.level") == "HIGH").alias("high"),
        half_up(F.avg("priority.score")).alias("mean_score"),
    )


def priority_badge() -> Column:
    level = F.col("priority.level")
    icon = F.when(level == "CRITICAL", "🚨").when(level == "HIGH", "🔴").when(level == "MEDIUM", "🟠").otherwise("🟢")
    return F.concat(icon, F.lit(" Priority: "), half_up(F.col("priority.score")).cast("string"), F.lit("/100"))


def priority_explanation() -> Column:
    """Lines that explain a score; array<string>."""
    p = lambda x: F.col(f"priority.{x}")
    n = lambda c: half_up(c).cast("string")
    plus = lambda label, x, end="": F.when(p(x) > 0, F.concat(F.lit(f"- {label}: +"), n(p(x)), F.lit(end)))
    return F.array_compact(
        F.array(
            F.concat(F.lit("**Priority Score**: "), n(p("score")), F.lit("/100 ("), p("level"), F.lit(")")),
            F.lit(""),
            F.lit("**Score Breakdown**:"),
            F.concat(F.lit("- Base Severity ("), F.col("severity"), F.lit("): +"), n(p("base"))),
            plus("CISA KEV (Known Exploited)", "known", " 🚨"),
            F.when(p("likely") > 0, F.concat(F.lit("- EPSS Score ("), n(F.col("epss") * 100), F.lit("%): +"), n(p("likely")), F.lit(" ⚡"))),
            plus("Public Exploit Available", "exploit"),
            plus("High Confidence", "sure"),
            plus("Business Context", "context"),
            F.when(p("reason").isNotNull(), ""),
            F.concat(F.lit("**Urgency**: "), p("reason")),
        )
    )


def misclassified() -> Column:
    """How suspicious a vulnerability is: 1 for code that its type is often mistaken for, and a half for high
    confidence on suspicious code."""
    snippet, kind, language = _SNIPPET(), _KIND(), _LANGUAGE()
    known = any_of(found(snippet, regex) & named(kind, types) & (F.lit(True) if lang == "any" else language == lang) for regex, types, lang in P.MISCLASSIFIED)
    doubtful = F.coalesce(F.col("confidence") >= 0.9, F.lit(False)) & any_of(found(snippet, r) for r in P.SUSPICIOUS)
    return F.when(known, 1.0).otherwise(0.0) + F.when(doubtful, 0.5).otherwise(0.0)


def report_quality(vulns: DataFrame, report: str = "report") -> DataFrame:
    """One row a report: the five parts of its quality, their weighted sum and the number of vulnerabilities.

    Rows of ``vulns`` without an id are reports without vulnerabilities: zeros, and a risk of 1.
    """
    real = F.col("id").isNotNull()
    on = lambda c: F.when(real, c)
    lined = filled(F.col("lines"))
    valid = F.forall("lines", lambda x: (x > 0) & (x < 100000)) & (F.array_max("lines") - F.array_min("lines") < 50)
    pattern = F.least(
        F.lit(1.0),
        0.5 + F.when(filled(F.col("patterns")), 0.15).otherwise(0.0) + F.when(has(F.col("cwe")), 0.1).otherwise(0.0) + F.when(has(F.col("owasp")), 0.1).otherwise(0.0)
        + F.when(has(F.col("vulnerable_code")) & has(F.col("secure_code")), 0.15).otherwise(0.0) + F.when(F.length("impact") > 20, 0.1).otherwise(0.0),
    )
    each = vulns.groupBy(report).agg(
        F.count("id").alias("n"),
        F.max("detected_language").alias("detected"),
        F.avg(on(F.col("language_confidence"))).alias("lang_mean"),
        F.count_distinct(on(F.nullif("language", F.lit("")))).alias("n_langs"),
        F.count(on(F.col("confidence"))).alias("n_conf"),
        F.var_pop(on(F.col("confidence"))).alias("variance"),
        F.sum(on(misclassified())).alias("suspicious"),
        F.count_if(real & lined).alias("n_lined"),
        F.count_if(real & lined & valid).alias("n_valid"),
        F.avg(on(pattern)).alias("pattern_mean"),
    )
    unknown = ~has(F.col("detected")) | (F.col("detected") == "unknown")
    language = F.when(unknown, 0.2).when(F.col("lang_mean").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.col("lang_mean") - F.when(F.col("n_langs") > 2, 0.2).otherwise(0.0)))
    none = F.col("n") == 0
    part = lambda c, empty=0.0: F.when(none, empty).otherwise(c)
    rows = each.select(
        report,
        "n",
        part(language).alias("language"),
        part(F.when(F.col("n_conf") < 2, 0.7).otherwise(1 - F.least(F.lit(1.0), F.col("variance") / 0.1))).alias("consistency"),
        part(F.least(F.lit(1.0), F.col("suspicious") / F.col("n")), 1.0).alias("risk"),
        part(F.when(F.col("n_lined") == 0, 0.3).otherwise(F.try_divide("n_valid", "n_lined"))).alias("lines"),
        part(F.col("pattern_mean")).alias("pattern"),
    )
    total = F.col("language") * 0.2 + F.col("consistency") * 0.15 + (1 - F.col("risk")) * 0.3 + F.col("lines") * 0.15 + F.col("pattern") * 0.2
    return rows.withColumn("accuracy", F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))))


# The gate's thresholds.
GATE = {"accuracy": 0.65, "language": 0.5, "risk": 0.35, "count": 1}


def quality_gate(quality: DataFrame, **limits: float) -> DataFrame:
    """Adds ``shown`` (the report passes) and ``issues`` (what fails; line accuracy below a half is named, too)."""
    g = GATE | limits
    percent = lambda c: F.format_string("%.1f", c * 100)
    issues = F.array_compact(
        F.array(
            F.when(F.col("accuracy") < g["accuracy"], F.concat(F.lit("Overall accuracy ("), percent(F.col("accuracy")), F.lit(f"%) below threshold ({g['accuracy'] * 100:.1f}%)"))),
            F.when(F.col("language") < g["language"], F.concat(F.lit("Language detection confidence ("), percent(F.col("language")), F.lit("%) below threshold"))),
            F.when(F.col("risk") > g["risk"], F.concat(F.lit("High misclassification risk ("), percent(F.col("risk")), F.lit("%)"))),
            F.when(F.col("lines") < 0.5, F.concat(F.lit("Line accuracy issues detected ("), percent(F.col("lines")), F.lit("%)"))),
        )
    )
    shown = (F.col("n") >= g["count"]) & (F.col("accuracy") >= g["accuracy"]) & (F.col("language") >= g["language"]) & (F.col("risk") <= g["risk"])
    return quality.withColumn("shown", shown).withColumn("issues", issues)
