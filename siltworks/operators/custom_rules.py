"""Rules as data: import, validation, selection, matching, tests, statistics and export.

A rule table has the columns of ``SCHEMA``. It is small by nature (rules are written by hand), so matching takes
the rules to the driver and makes one projection of them; documents stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import severity as severities
from siltworks.functions import text
from siltworks.operators.match import matches, newlines
from siltworks.session import spread
from siltworks.sources.files import languages

_PATTERN = "struct<type:string,value:string,flags:string,multiline:boolean,confidence:double>"
_TEST = "struct<name:string,code:string,language:string,shouldMatch:boolean,expectedMatches:int,expectedLine:int>"
SCHEMA = (
    "id string, name string, description string, version string, severity string, category string, languages array<string>, "
    f"patterns array<{_PATTERN}>, message struct<default:string,fix:string,placeholders:map<string,string>>, "
    f"enabled boolean, testCases array<{_TEST}>, deprecated boolean, deprecationMessage string, "
    "fixes array<struct<description:string,confidence:double>>, tags array<string>, metadata struct<cwe:array<string>,owasp:array<string>>"
)
# What a rule must have, and what its parts may be.
REQUIRED = ("id", "name", "description", "version", "severity", "category", "languages", "patterns", "message")
ID = r"^[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]$"
VERSION = r"^\d+\.\d+\.\d+$"
CATEGORIES = ("security", "quality", "performance", "style", "best_practice", "compliance", "custom")
PATTERN_TYPES = ("regex", "ast", "semantic", "dataflow")
CONFIDENCE, FIX_CONFIDENCE = 0.8, 0.7
#: Different broken patterns that a table may have, and rules that are matched with at once.
BROKEN, RULES = 10_000, 5_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files that hold an object with a list ``rules``; ``pack`` is the file's id where it has one."""
    files = spark.read.schema(f"id string, name string, version string, rules array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _fields())}>>").option("multiLine", True).json(path)
    return files.select(F.col("id").alias("pack"), F.posexplode("rules").alias("ord", "r")).select("pack", "ord", "r.*")


def _fields() -> list[str]:
    out, depth, word = [], 0, ""
    for c in SCHEMA:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def java_regex(value: str, flags: str | None, multiline: bool | None) -> str:
    """Flags become inline ones, each once; matching is always global."""
    own = sorted(set(flags or "") & set("ims") | ({"m"} if multiline else set()))
    return f"(?{''.join(own)}){value}" if own else value


def broken_patterns(rules: DataFrame) -> dict[str, str]:
    """The regexes that do not compile, with the reason. They are tried where they are; only those come to the driver, for the reason."""
    jvm = rules.sparkSession._jvm
    rows = rules.select(F.explode("patterns").alias("p")).filter("p.type = 'regex' and p.value is not null").select("p.value").distinct().filter(~compiles(F.col("value"))).limit(BROKEN + 1).collect()
    if len(rows) > BROKEN:
        raise ValueError(f"more than {BROKEN} different patterns do not compile")
    out = {}
    for r in rows:
        try:
            jvm.java.util.regex.Pattern.compile(r.value)
        except Exception as e:  # py4j wraps PatternSyntaxException
            out[r.value] = str(getattr(e, "java_exception", e)).splitlines()[0].split(": ", 1)[-1]
    return out


def validate(rules: DataFrame) -> DataFrame:
    """Adds ``errors`` (array<struct<field, message>>), ``warnings`` and ``valid``.

    What the table says of a least number of languages or patterns is not asked: an empty list passes.
    """
    say = lambda test, field, message: F.when(test, F.struct((field if isinstance(field, Column) else F.lit(field)).alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    broken = broken_patterns(rules)
    checks = [say(F.col(f).isNull(), f, f"Missing required field: {f}") for f in REQUIRED]
    checks += [
        say(has("id") & ~F.col("id").rlike(ID), "id", "Invalid ID format. Must be alphanumeric with hyphens."),
        say(has("name") & (F.length("name") < 3), "name", "Name must be at least 3 characters"),
        say(F.length("name") > 100, "name", "Name must be at most 100 characters"),
        say(has("version") & ~F.col("version").rlike(VERSION), "version", "Version must be in semver format (x.y.z)"),
        say(has("severity") & ~F.col("severity").isin(*severities.ORDER), "severity", f"Invalid severity. Must be one of: {', '.join(severities.ORDER)}"),
        say(has("category") & ~F.col("category").isin(*CATEGORIES), "category", f"Invalid category. Must be one of: {', '.join(CATEGORIES)}"),
        say(F.col("message").isNotNull() & ~has("message.default"), "message.default", "Default message is required"),
    ]

    def of_pattern(p: Column, i: Column) -> Column:
        field = lambda name: F.concat(F.lit("patterns["), i.cast("string"), F.lit(f"].{name}"))
        reason = F.lit(None).cast("string")
        for value, why in broken.items():
            reason = F.when(p["value"] == value, f"Invalid regex pattern: {why}").otherwise(reason)
        return F.array(
            say(~F.coalesce(p["type"].isin(*PATTERN_TYPES), F.lit(False)), field("type"), f"Invalid pattern type. Must be one of: {', '.join(PATTERN_TYPES)}"),
            say(~F.coalesce(F.length(p["value"]) > 0, F.lit(False)), field("value"), "Pattern value is required"),
            say((p["type"] == "regex") & reason.isNotNull(), field("value"), reason),
        )

    patterns = F.coalesce(F.flatten(F.transform("patterns", of_pattern)), F.array().cast("array<struct<field:string,message:string>>"))
    warnings = F.array_compact(
        F.array(
            say(F.coalesce(F.size("testCases"), F.lit(0)) <= 0, "testCases", "No test cases defined. Consider adding tests for better reliability."),
            say(F.col("deprecated") & ~has("deprecationMessage"), "deprecationMessage", "Deprecated rule should have a deprecation message."),
            say((F.col("category") == "security") & F.col("metadata.cwe").isNull(), "metadata.cwe", "Security rules should include CWE references."),
        )
    )
    out = rules.withColumn("errors", F.array_compact(F.concat(F.array(*checks), patterns))).withColumn("warnings", warnings)
    return out.withColumn("valid", F.size("errors") == 0)


def validate_packs(rules: DataFrame, packs: DataFrame) -> DataFrame:
    """pack, field, message: what is wrong with packs(id, name, version) and their rules(pack, ord, ...), repeated ids included."""
    checked = validate(rules)
    nth = F.row_number().over(Window.partitionBy("pack", "id").orderBy("ord"))
    field = lambda name: F.concat(F.lit("rules["), F.col("ord").cast("string"), F.lit("]."), name)
    twice = checked.withColumn("_n", nth).filter("_n > 1").select("pack", field(F.lit("id")).alias("field"), F.concat(F.lit("Duplicate rule ID: "), "id").alias("message"))
    own = checked.select("pack", "ord", F.explode("errors").alias("e")).select("pack", field(F.col("e.field")).alias("field"), F.col("e.message").alias("message"))
    full = packs.join(rules.select(F.col("pack").alias("id")).distinct().withColumn("_has", F.lit(True)), "id", "left")
    say = lambda test, f, m: F.when(test, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message")))
    none = lambda c: ~F.coalesce(F.length(c) > 0, F.lit(False))
    heads = F.array_compact(F.array(say(none("id"), "id", "Pack ID is required"), say(none("name"), "name", "Pack name is required"), say(none("version"), "version", "Pack version is required"), say(F.col("_has").isNull(), "rules", "Pack must contain at least one rule")))
    return full.select(F.col("id").alias("pack"), F.explode(heads).alias("e")).select("pack", "e.field", "e.message").unionByName(twice).unionByName(own)


def imported(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rules, and one line for each of the others."""
    checked = validate(rules)
    line = F.concat(F.lit("Rule "), F.coalesce("id", F.lit("undefined")), F.lit(": "), F.array_join(F.transform("errors", lambda e: e["message"]), ", "))
    return checked.filter("valid").drop("errors", "warnings", "valid"), checked.filter("not valid").select("id", line.alias("error"))


def select(rules: DataFrame, ids: Iterable[str] | None = None, categories: Iterable[str] | None = None, min_severity: str | None = None, language: str | None = None) -> DataFrame:
    """Enabled rules by id, category, least severity and language."""
    out = rules.filter("enabled")
    if ids is not None:
        out = out.filter(F.col("id").isin(*ids))
    if categories is not None:
        out = out.filter(F.col("category").isin(*categories))
    if min_severity is not None:
        out = out.filter(severities.at_least(F.col("severity"), min_severity))
    if language is not None:
        out = out.filter(F.exists("languages", lambda x: (x == "*") | (F.lower(x) == language.lower())))
    return out


def added(rules: DataFrame, more: DataFrame) -> DataFrame:
    """The later of two rules with one id wins."""
    return rules.join(more.select("id"), "id", "left_anti").unionByName(more)


def appended(rules: DataFrame, more: DataFrame) -> DataFrame:
    """All rules; ids may repeat."""
    return rules.unionByName(more)


def removed(rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    return rules.filter(~F.col("id").isin(*ids))


def switched(rules: DataFrame, ids: Sequence[str], on: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("id").isin(*ids), F.lit(on)).otherwise(F.col("enabled")))


@dataclass(frozen=True)
class Compiled:
    id: str
    name: str
    severity: str
    category: str
    languages: tuple[str, ...]
    regexes: tuple[str, ...]
    message: str
    suggestion: str | None
    confidence: float
    fix: str | None


def compiled(rules: DataFrame) -> list[Compiled]:
    """Rules as the matcher takes them, by ``ord`` where there is one; patterns that do not compile, and those of
    other types than regex, are left out."""
    broken = broken_patterns(rules)
    out = []
    rows = (rules.orderBy("ord") if "ord" in rules.columns else rules).limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"more than {RULES} rules to match with")
    for r in rows:
        patterns = r.patterns or []
        message = (r.message.default if r.message else None) or ""
        for key, value in sorted(((r.message.placeholders if r.message else None) or {}).items()):
            message = message.replace("{{" + key + "}}", value, 1)
        regexes = tuple(java_regex(p.value, p.flags, p.multiline) for p in patterns if p.type == "regex" and p.value and p.value not in broken)
        fix = next((f.description for f in r.fixes or [] if (f.confidence or 0) >= FIX_CONFIDENCE), None)
        out.append(Compiled(r.id, r.name, r.severity, r.category, tuple(x.lower() for x in r.languages or []), regexes, message, r.message.fix if r.message else None, (patterns[0].confidence if patterns else None) or CONFIDENCE, fix))
    return out


_MATCH = "array<struct<rule_id:string,rule_name:string,severity:string,category:string,seq:int,message:string,line:int,column:int,end_line:int,end_column:int,snippet:string,suggestion:string,fix:string,confidence:double,match:string>>"


def _match_of(rule: Compiled, seq: int, groups: dict[int, Column], lines: Column):
    """What the matcher says of one match; captures that the regex does not have stay in the message as they are."""

    def one(s: Column) -> Column:
        n = newlines(s["match"])
        end_line = s["line"] + n
        end_column = F.when(n > 0, F.length(F.substring_index(s["match"], "\n", -1))).otherwise(s["col"] + F.length(s["match"]))
        message = text.template(F.lit(rule.message), {f"${g}": F.get(found, s["k"]) for g, found in groups.items()})
        first = F.greatest(F.lit(1), s["line"] - 1)
        snippet = F.array_join(F.slice(lines, first, end_line + 2 - first + 1), "\n")
        return F.struct(
            F.lit(rule.id), F.lit(rule.name), F.lit(rule.severity), F.lit(rule.category), F.lit(seq), message, s["line"], s["col"], end_line, end_column, snippet,
            F.lit(rule.suggestion).cast("string"), F.lit(rule.fix).cast("string"), F.lit(float(rule.confidence)), s["match"],
        )

    return one


def match(docs: DataFrame, rules: DataFrame | list[Compiled], path: str = "path", content: str = "content", language: str | None = None, max_matches: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """One row a match, with end positions, snippet and the message with captures filled in.

    A rule applies where a name of the path's language, or of the column ``language``, is among its languages. With
    ``max_matches`` a document takes no further rule once it has as many; the last rule's matches stay whole.
    """
    found_rules = rules if isinstance(rules, list) else compiled(rules)
    body = F.col(content)
    names = F.array(F.lower(F.col(language))) if language else languages(F.col(path))
    lines = F.split(body, "\n", -1)
    arrays = []
    for i, rule in enumerate(found_rules):
        here = F.lit(True) if "*" in rule.languages else F.arrays_overlap(names, F.array(*map(F.lit, rule.languages)).cast("array<string>"))
        of_rule = []
        for j, regex in enumerate(rule.regexes):
            used = [g for g in range(10) if f"{{{{${g}}}}}" in rule.message]
            most = docs.sparkSession._jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount() if used else 0
            groups = {g: F.regexp_extract_all(body, F.lit(regex), F.lit(g)) for g in used if g <= most}

            of_rule.append(F.coalesce(F.transform(F.when(here, matches(body, regex)), _match_of(rule, 100 * i + j, groups, lines)).cast(_MATCH), F.array().cast(_MATCH)))
        arrays.append(F.flatten(F.array(*of_rule)) if of_rule else F.array().cast(_MATCH))
    if not arrays:
        out = F.array().cast(_MATCH)
    elif max_matches is None:
        out = F.flatten(F.array(*arrays))
    else:
        out = reduce(lambda acc, more: F.when(F.size(acc) >= max_matches, acc).otherwise(F.concat(acc, more)), arrays)
    return spread(docs).select(F.col(path), *keep, F.explode(out).alias("m")).select(path, *keep, "m.*")


def by_severity(found: DataFrame) -> DataFrame:
    """The order of a list of matches: by severity, then as found."""
    return found.orderBy(severities.rank(F.col("severity")), "seq", "line", "column")


def compiles(regex: Column) -> Column:
    """Whether a regex is one, tried where the row is."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), regex).isNotNull()


def _regex(p: Column) -> Column:
    """``java_regex`` of a pattern's columns."""
    has = lambda flag: F.coalesce(F.contains(p["flags"], F.lit(flag)), F.lit(False))
    own = F.concat(F.when(has("i"), "i").otherwise(""), F.when(has("m") | F.coalesce(p["multiline"], F.lit(False)), "m").otherwise(""), F.when(has("s"), "s").otherwise(""))
    return F.concat(F.when(own != "", F.concat(F.lit("(?"), own, F.lit(")"))).otherwise(""), p["value"])


def run_tests(rules: DataFrame) -> DataFrame:
    """id, test, passed, found: each test case's code scanned by its own rule, if that applies to the language it names.

    A case is worked out inside its row, patterns and all, so a rule table may have any size.
    """
    rows = rules.select("id", "languages", "patterns", F.explode("testCases").alias("t"))
    here = F.coalesce(F.exists("languages", lambda x: (x == "*") | (F.lower(x) == F.lower("t.language"))), F.lit(False))
    usable = F.filter("patterns", lambda p: (p["type"] == "regex") & (F.length(p["value"]) > 0) & compiles(_regex(p)))
    lines = F.flatten(F.transform(usable, lambda p: F.transform(F.coalesce(matches(F.col("t.code"), _regex(p)), F.array().cast("array<struct<match:string,start:int,line:int,col:int,k:int>>")), lambda m: m["line"])))
    rows = rows.select("id", "t", F.coalesce(F.when(here, lines), F.array().cast("array<int>")).alias("_lines"))
    found = F.size("_lines")
    wanted = (found > 0) & F.coalesce(found == F.col("t.expectedMatches"), F.lit(True)) & F.coalesce(F.array_contains("_lines", F.col("t.expectedLine")), F.col("t.expectedLine").isNull())
    return rows.select("id", F.col("t.name").alias("test"), F.when(F.col("t.shouldMatch"), wanted).otherwise(found == 0).alias("passed"), found.cast("long").alias("found"))


def statistics(rules: DataFrame) -> DataFrame:
    """what (total, enabled, category, severity, language), name, n."""
    pair = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    own = F.array_compact(F.array(pair("total", F.lit("")), F.when(F.col("enabled"), pair("enabled", F.lit(""))), pair("category", F.col("category")), pair("severity", F.col("severity"))))
    each = rules.select(F.explode(F.concat(own, F.transform("languages", lambda x: pair("language", x)))).alias("e"))
    return each.groupBy("e.what", "e.name").agg(F.count("*").alias("n"))


def coverage(findings: DataFrame, applicable: int, total: int) -> DataFrame:
    """One row: how many different rules were triggered, and the share of rules that applied, in percent."""
    return findings.agg(F.count_distinct("rule_id").alias("rules_triggered"), F.lit(100.0 * applicable / total if total else 0.0).alias("coverage"))


def vocabulary(rules: DataFrame) -> DataFrame:
    """One row: the languages and categories of all rules, sorted."""
    return rules.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"), F.array_sort(F.collect_set("category")).alias("categories"))


def exported(rules: DataFrame, at: str) -> DataFrame:
    """One row: the rules as JSON in an envelope with the time ``at``."""
    return rules.agg(F.to_json(F.struct(F.lit("1.0.0").alias("version"), F.lit(at).alias("exportedAt"), F.collect_list(F.struct(*(x.strip().split(" ")[0] for x in _fields()))).alias("rules"))).alias("json"))


def export_rows(rules: DataFrame, at: str) -> DataFrame:
    """The same document as ordered rows (part, seq, text), for tables of any size: a head, a rule a row, and an end."""
    fields = [x.strip().split(" ")[0] for x in _fields()]
    first = rules.agg(F.min("ord").alias("_first"))
    head = first.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit('{"version":"1.0.0","exportedAt":'), F.lit(f'"{at}"'), F.lit(',"rules":[')).alias("text"))
    body = rules.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("seq"), F.concat(F.when(F.col("ord") > F.col("_first"), ",").otherwise(""), F.to_json(F.struct(*fields))).alias("text"))  # one row
    return head.unionByName(body).unionByName(first.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("]}").alias("text")))


def applicable(asked: DataFrame, rules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """asked(disabled array, categories array or null, and the columns to ``keep``) with the rules(id, category, enabled, priority) of each:
    rule_id and place, by priority and id. The rules, of which there are few, are one array in each row's reach."""
    few = rules.limit(RULES + 1).select("priority", "id", "category", "enabled").collect()
    if len(few) > RULES:
        raise ValueError(f"more than {RULES} rules to choose from")
    listed = F.array(*(F.struct(F.lit(r.priority).alias("priority"), F.lit(r.id).alias("id"), F.lit(r.category).alias("category"), F.lit(r.enabled).alias("enabled")) for r in sorted(few, key=lambda r: (r.priority, r.id))))
    fits = lambda r: r["enabled"] & ~F.coalesce(F.array_contains("disabled", r["id"]), F.lit(False)) & (F.col("categories").isNull() | F.array_contains("categories", r["category"]))
    return asked.select(*keep, F.posexplode(F.filter(listed, fits)).alias("place", "r")).select(*keep, F.col("r.id").alias("rule_id"), "place")
