"""Groupings and lists that views show: findings, dependencies, licences, fixes, feedback, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import severity as severities
from siltworks.functions.scoring import half_up

# Orders of dependencies by type and of licences by risk, limits of lists.
DEPENDENCY_ORDER = {"direct": 0, "dev": 1, "peer": 2, "optional": 3, "transitive": 4}
RISK_ORDER = {"high": 0, "medium": 1, "low": 2, "unknown": 3}
DEPENDENCIES, TYPES, PER_FILE = 100, 10, 50


def file_results(files: DataFrame, issues: DataFrame) -> DataFrame:
    """files(path) and issues(path, severity): path, n, score of every file; files of issues alone appear, too, and
    issues without a path do not."""
    both = files.select("path").distinct().join(issues.filter("path is not null").select("path", "severity"), "path", "full")
    return both.groupBy("path").agg(F.count("severity").alias("n"), severities.score(F.col("severity")).alias("score"))


def files_by_count(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("n"), "path")


def grouped(findings: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """key, n, first: groups in the order of their first finding; the findings stay rows of their own table."""
    return findings.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def nested_groups(findings: DataFrame, outer: str, inner: str, order: str = "seq") -> DataFrame:
    """outer, inner, n, outer_n, outer_place: groups in groups; the outer ones by their count, largest first."""
    each = findings.groupBy(outer, inner).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = each.groupBy(outer).agg(F.sum("n").alias("outer_n"), F.count("*").alias("inner_n"))
    return each.join(top, outer).select(outer, inner, "n", "first", "outer_n", "inner_n")


def severity_groups(findings: DataFrame, column: str = "severity") -> DataFrame:
    """severity, n, rank: known severities that occur, in rank order."""
    return findings.filter(F.col(column).isin(*severities.ORDER)).groupBy(column).agg(F.count("*").alias("n")).withColumn("rank", severities.rank(F.col(column)))


def summary_rows(findings: DataFrame, *by: str, column: str = "severity") -> DataFrame:
    """by, label, n: a row for each severity that occurs, with its title."""
    named = findings.filter(F.col(column).isin(*severities.ORDER[:4]))
    return named.groupBy(*by, F.initcap(column).alias("label")).agg(F.count("*").alias("n"))


def vulnerabilities_by_rank(vulns: DataFrame) -> DataFrame:
    return vulns.orderBy(severities.rank(F.col("severity")), "seq")


def _order(col: Column, table: dict[str, int]) -> Column:
    return severities.mapped(col, table, len(table))


def dependencies(deps: DataFrame, by: list[str] | None = None, most: int = DEPENDENCIES) -> DataFrame:
    """The first so many dependencies(name, type) by type, then name without regard to case."""
    w = Window.partitionBy(*(by or [])).orderBy(_order(F.col("type"), DEPENDENCY_ORDER), F.lower("name"), "name")
    return deps.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def licenses(risks: DataFrame, names: DataFrame) -> DataFrame:
    """risks(license, risk) and all other licences of names(license) with the risk unknown; ``place`` orders by risk."""
    rest = names.select("license").filter("license is not null").distinct().join(risks.select("license"), "license", "left_anti").withColumn("risk", F.lit("unknown"))
    return risks.select("license", "risk").unionByName(rest).withColumn("place", _order(F.col("risk"), RISK_ORDER))


def compliant(risks: DataFrame, *by: str) -> DataFrame:
    """No licence of high risk."""
    return risks.groupBy(*by).agg((F.count_if(F.col("risk") == "high") == 0).alias("compliant"))


def with_vulnerability(diagnostics: DataFrame, vulns: DataFrame) -> DataFrame:
    """Each diagnostic(code) with the vulnerability of its code, and which kind of actions it gets."""
    v = vulns.select(F.col("code").alias("_c"), *(c for c in vulns.columns if c != "code"))
    return diagnostics.join(v, F.col("code") == F.col("_c"), "left").withColumn("kind", F.when(F.col("_c").isNotNull(), "specific").otherwise("basic")).drop("_c")


def auto_fixes(fixes: DataFrame) -> DataFrame:
    """fixes(fixable, confidence, breaking, start_line): those to apply by themselves, from the bottom up."""
    return fixes.filter(F.col("fixable") & (F.col("confidence") == "auto_apply") & ~F.coalesce("breaking", F.lit(False))).orderBy(F.desc("start_line"))


def cve_lookup(cves: DataFrame, query: str | None = None, cwe: str | None = None, kind: str | None = None, language: str | None = None, code: str | None = None) -> DataFrame:
    """Rows of cves(cwe, type, title, language, vulnerable_code, ...) that fit all that is asked; ``code`` must contain the vulnerable code."""
    out = cves
    if query is not None:
        out = out.filter(F.contains(F.lower("title"), F.lit(query.lower())) | F.contains(F.lower("type"), F.lit(query.lower())))
    if cwe is not None:
        out = out.filter(F.upper("cwe") == cwe.upper())
    if kind is not None:
        out = out.filter(F.lower("type") == kind.lower())
    if language is not None:
        out = out.filter(F.lower("language") == language.lower())
    if code is not None:
        out = out.filter(F.contains(F.lit(code), F.trim("vulnerable_code")))
    return out


def first_fix(cves: DataFrame, cwe: str, language: str, order: str = "seq") -> DataFrame:
    return cve_lookup(cves, cwe=cwe, language=language).orderBy(order).limit(1)


def with_view_time(actions: DataFrame, views: DataFrame, key: str, at: str) -> DataFrame:
    """Adds ``time_to_action`` in ms since the last view of the same key at or before the action; null without one."""
    from siltworks.operators.joins import asof

    out = asof(actions, views.withColumn("_viewed", F.col(at)), key, at, "_viewed")
    return out.withColumn("time_to_action", F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("asof_value").cast("timestamp"))) / 1000)).drop("asof_value")


def accuracy(feedback: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, total, accepted, rejected, rate: over all feedback(action), and by each dimension where it is set.

    Fixed counts as accepted; the rate is 0 where nothing was decided. One pass by grouping sets.
    """
    sets = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    rows = feedback.select("action", F.explode(F.filter(sets, lambda s: s["value"].isNotNull())).alias("s")).select("action", "s.*")
    accepted, rejected = F.count_if(F.col("action").isin("ACCEPTED", "FIXED")), F.count_if(F.col("action") == "REJECTED")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("total"), accepted.alias("accepted"), rejected.alias("rejected"), F.round(F.coalesce(F.try_divide(accepted, accepted + rejected), F.lit(0.0)), 6).alias("rate"))


def top_types(rates: DataFrame, most: int = TYPES) -> DataFrame:
    """The types with the most feedback, their rates as whole percents."""
    return rates.orderBy(F.desc("total"), "value").limit(most).select("value", "total", F.concat(half_up(F.col("rate") * 100).cast("string"), F.lit("%")).alias("percent"))


def rating(kind: Column, value: Column) -> Column:
    """A rating from 1 to 5, or null."""
    return F.when(kind.isNotNull() & value.between(1, 5), value.cast("int"))


def plugin_statistics(plugins: DataFrame, *by: str) -> DataFrame:
    return plugins.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("enabled", "disabled", "error")), F.count_if(F.col("type").isNull()).alias("unknown_type"))


def restored(plugins: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved state saved(id, enabled) on plugins(id, status); ids that are not there are ignored."""
    s = saved.select(F.col("id").alias("_i"), F.col("enabled").alias("_on"))
    out = plugins.join(s, F.col("id") == F.col("_i"), "left")
    return out.withColumn("status", F.when(F.col("_on"), "enabled").when(~F.col("_on"), "disabled").otherwise(F.col("status"))).drop("_i", "_on")


def discovered(found: DataFrame, by: list[str] | None = None, most: int = 50) -> DataFrame:
    """found(id, path, is_dir, has_manifest, seq): folders with a manifest and loose rule files, each id once, at most so many."""
    some = found.filter((F.col("is_dir") & F.col("has_manifest")) | (~F.col("is_dir") & F.endswith("path", F.lit(".json"))))
    first = Window.partitionBy(*(by or []), "id").orderBy("seq")
    once = some.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or [])).orderBy("seq"))).filter(F.col("_n") <= most).withColumn("kind", F.when(F.col("is_dir"), "plugin").otherwise("rules")).drop("_n")


LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def log_lines(entries: DataFrame) -> DataFrame:
    """entries(seq, at, level from 0, message) as lines of text, in order by seq."""
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    return entries.select("seq", F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] ["), name, F.lit("] "), F.col("message")).alias("line"))
