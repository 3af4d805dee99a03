"""Match-generate: documents and rules in, positioned findings out.

Each pattern is a literal in one projection, so it is compiled once and the text is scanned in a single
stage; nothing is shuffled until findings are ranked. Matches of zero width are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import scoring, severity, text
from siltworks.plans.rules import Rule
from siltworks.session import spread


def newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.translate(col, "\n", ""))


_PLACE = "array<struct<match:string,start:int,line:int,col:int,k:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(col: Column, regex: str | Column) -> Column:
    """array<struct<match, start, line, col, k>>: all non-overlapping matches with their 0-based offsets, 1-based lines,
    0-based columns and numbers from 0; null where nothing matches.

    What lies between matches is what ``split`` gives. A fold over gaps and matches carries the position along; as a fold
    copies what it has gathered at each step, it gathers in blocks, as many as a block has matches, whose
    first positions come from a fold that gathers those only.
    """
    test = col.rlike(regex) if isinstance(regex, str) else F.rlike(col, regex)
    found = F.regexp_extract_all(col, F.lit(regex), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(col, regex, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def after(line: Column, column: Column, part: Column) -> tuple[Column, Column]:
        n = newlines(part)
        return line + n, F.when(n > 0, F.length(F.substring_index(part, "\n", -1))).otherwise(column + F.length(part))

    def moved(at: Column, pair: Column) -> tuple[tuple[Column, Column, Column], Column]:
        """Where the match of a pair is, and the position after it."""
        gap, match = F.coalesce(pair["g"], F.lit("")), pair["m"]
        pos = at["pos"] + F.length(gap)
        line, column = after(at["line"], at["col"], gap)
        next_line, next_column = after(line, column, match)
        return (pos, line, column), F.struct((pos + F.length(match)).alias("pos"), next_line.alias("line"), next_column.alias("col"), (at["k"] + 1).alias("k"))

    def first(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["at"], lambda at, pair: moved(at, pair)[1]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def gathered(acc: Column, pair: Column) -> Column:
        (pos, line, column), then = moved(acc["at"], pair)
        here = F.struct(pair["m"].alias("match"), pos.alias("start"), line.alias("line"), column.alias("col"), acc["at"]["k"].alias("k"))
        return F.struct(then.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("k"))
        firsts = F.aggregate(blocks, F.struct(start.alias("at"), F.array().cast("array<struct<pos:int,line:int,col:int,k:int>>").alias("out")), first, lambda acc: acc["out"])
        one = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_PLACE).alias("out")), gathered, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, firsts, one))

    def in_blocks(all_pairs: Column) -> Column:
        size = F.size(all_pairs)
        width = F.ceil(F.sqrt(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), size - 1, width), lambda i: F.slice(all_pairs, i + 1, width))

    out = _bound(pairs, lambda x: _bound(in_blocks(x), placed))
    return F.when(test, F.filter(out, lambda s: s["match"] != ""))


def applicable(rules: Iterable[Rule], disabled: Iterable[str] = (), categories: Iterable[str] | None = None) -> list[Rule]:
    """Enabled rules that are neither disabled nor outside the categories, by priority."""
    off, only = set(disabled), None if categories is None else set(categories)
    return sorted((r for r in rules if r.enabled and r.id not in off and (only is None or r.category in only)), key=lambda r: r.priority)


def needed(regex: str) -> list[str]:
    """Lower-case texts of which one at least is in whatever a regex matches, in lower case; none where that is not known.

    The longest run of plain characters that each match has; of alternatives, one of each.
    """
    from re import _constants as kinds
    from re import _parser

    def best(options: list[list[str]]) -> list[str]:
        return max(options, key=lambda words: (min(map(len, words)), -len(words)), default=[])

    def of(items) -> list[str]:
        options, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is kinds.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if run:
                options.append([run])
                run = ""
            if kind is kinds.SUBPATTERN:
                options.append(of(value[-1]))
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                options.append(of(value[2]))
            elif kind is kinds.BRANCH:
                ways = [of(way) for way in value[1]]
                options.append(sorted({w for way in ways for w in way}) if all(ways) else [])
        return best([o for o in options if o])

    try:
        return of(_parser.parse(regex))
    except (re.error, OverflowError):  # a dialect of its own; each text is then tried
        return []


_PATTERNS = "array<struct<rule_id:string,severity:string,category:string,name:string,cwe:array<string>,languages:array<string>,doubtful:array<string>,seq:int,regex:string,negative:string,need:array<string>>>"


def _listed(rules: list[Rule]) -> Column:
    """All patterns of the rules as one literal."""
    rows = [
        {"rule_id": r.id, "severity": r.severity, "category": r.category, "name": r.name, "cwe": list(r.cwe), "languages": list(r.languages), "doubtful": [f"(?i){x}" for x in r.false_positives], "seq": 100 * i + j, "regex": p.regex,
         # negative patterns look inside the matched text only, in either case
         "negative": f"(?i){'|'.join(p.negative)}" if p.negative else None, "need": needed(p.regex)}
        for i, r in enumerate(rules) for j, p in enumerate(r.patterns)
    ]
    return F.from_json(F.lit(json.dumps(rows)), _PATTERNS)


def scan(docs: DataFrame, rules: Iterable[Rule], key: str, content: str, language: str | None = None, keep: Iterable[str] = (), details: bool = False) -> DataFrame:
    """One row a match: key, the columns to ``keep``, rule_id, severity, category, seq, match, start, line, col, confidence.

    With ``details`` also name, cwe, likelihood (of a false positive) and snippet (one line before, two after).

    All patterns are one literal, and a text is only tried with those of its language of which it has a text that each match
    has; so the plan is of one size for any number of rules.
    """
    keep = list(keep)
    body = F.col(content)

    def possible(low: Column):
        def test(p: Column) -> Column:
            has = (F.size(p["need"]) == 0) | F.exists(p["need"], lambda w: F.contains(low, w))
            return has if language is None else (F.array_contains(p["languages"], "*") | F.coalesce(F.array_contains(p["languages"], F.col(language)), F.lit(False))) & has

        return test

    def found(p: Column) -> Column:
        some = F.filter(F.coalesce(matches(body, p["regex"]), F.array().cast(_PLACE)), lambda s: p["negative"].isNull() | ~F.rlike(s["match"], p["negative"]))

        def one(s: Column, lines: Column | None = None) -> Column:
            fields = [*(p[c].alias(c) for c in ("rule_id", "severity", "category", "seq")), *(s[c].alias(c) for c in ("match", "start", "line", "col"))]
            if details:
                # the lines around are cut inside the row, so that the text is not copied to each finding
                fields += [*(p[c].alias(c) for c in ("name", "cwe", "doubtful")), text.snippet(lines, s["line"]).alias("snippet")]
            return F.struct(*fields)

        if not details:
            return F.transform(some, lambda s: one(s))
        return _bound(F.split(body, "\n", -1), lambda lines: F.transform(some, lambda s: one(s, lines)))

    patterns = _bound(F.lower(body), lambda low: F.filter(_listed(applicable(rules)), possible(low)))
    rows = spread(docs).select(F.col(key), *keep, F.explode(F.flatten(F.transform(patterns, found))).alias("m")).select(key, *keep, "m.*")
    out = [
        key, *keep, "rule_id", "severity", "category", "seq", "match", F.col("start").cast("long").alias("start"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"),
        scoring.confidence(F.col("match"), F.col("severity")).alias("confidence"),
    ]
    return rows.select(*out, "snippet", "name", "cwe", scoring.false_positive(F.col("match"), F.col("doubtful")).alias("likelihood")) if details else rows.select(*out)


def best_of_place(findings: DataFrame, key: str) -> DataFrame:
    """One finding for each (document, rule, line, column): the most confident, the earliest on a tie."""
    w = Window.partitionBy(key, "rule_id", "line", "col").orderBy(F.desc("confidence"), "seq")
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity.rank(F.col("severity")), "line", "seq")


def line_scan(files: DataFrame, rules: Iterable[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """Line rules: each line at most once a rule. path, rule_id, name, severity, line."""
    lines = files.select(path, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line_text"))
    hits = F.filter(F.array(*(F.when(F.col("line_text").rlike(r.patterns[0].regex), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules)), lambda x: x.isNotNull())
    return lines.select(path, (F.col("pos") + 1).cast("long").alias("line"), F.explode(hits).alias("h")).select(path, "h.rule_id", "h.name", "h.severity", "line")


def missing_user(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Container files that name no user, or root, at their first FROM line (else line 1). All inside the row."""
    body = F.coalesce(F.col(content), F.lit(""))
    bad = ~body.rlike(r"(?im)^USER\s+\S+") | body.rlike(r"(?im)^USER\s+root\s*$")
    at = F.array_position(F.transform(F.split(body, "\n", -1), lambda t: t.rlike(r"(?i)^FROM\s")), True)
    return files.filter(bad).select(path, F.lit("IAC-D11").alias("rule_id"), F.lit("No non-root USER specified").alias("name"), F.lit("high").alias("severity"), F.greatest(F.lit(1), at).cast("long").alias("line"))


def file_type(path: Column, content: Column) -> Column:
    """Kind of an infrastructure file by name, then extension, then content; null where it is none. The patterns are fixed values."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    yaml = name.rlike(r"\.ya?ml$")
    return (
        F.when(name.startswith("dockerfile"), "dockerfile")
        .when(name.startswith("docker-compose") | name.startswith("compose"), "docker-compose")
        .when(name.endswith(".tf"), "terraform")
        .when(yaml & content.rlike(r"(?i)apiVersion:\s*(?:v1|apps/v1|networking\.k8s\.io|batch/v1)|kind:\s*(?:Pod|Deployment|Service|ConfigMap|Secret|Ingress)"), "kubernetes")
        .when(yaml & content.rlike("(?i)AWSTemplateFormatVersion|Resources:"), "cloudformation")
        .when(yaml & F.contains(path, F.lit("/templates/")) & content.rlike(r"\{\{.*\}\}"), "helm")
        .when(yaml & content.rlike("(?m)^services:"), "docker-compose")
        .when(name.endswith(".json") & content.rlike("(?i)AWSTemplateFormatVersion|Resources"), "cloudformation")
    )


def helm_scan(files: DataFrame, rules: Iterable[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """Templates are scanned like manifests; the rule ids tell them apart."""
    return manifest_scan(files, rules, path, content).withColumn("rule_id", F.regexp_replace("rule_id", "kubernetes", "helm"))


def infra_scan(files: DataFrame, line_rules: dict[str, Iterable[Rule]], manifest_rules: Iterable[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """All scans of infrastructure files by their kind, united. ``type`` is computed where it is missing."""
    if "type" not in files.columns:
        files = files.withColumn("type", file_type(F.col(path), F.col(content)))
    of = lambda kind: files.filter(F.col("type") == kind)
    out = missing_user(of("dockerfile"), path, content)
    for kind, rules in line_rules.items():
        out = out.unionByName(line_scan(of(kind), rules, path, content))
    return out.unionByName(manifest_scan(of("kubernetes"), manifest_rules, path, content)).unionByName(helm_scan(of("helm"), manifest_rules, path, content))


def last_start_line(body: Column, regex: str) -> Column:
    """The line, from 0, of the last place where a match begins, whatever other matches it lies in; null without one.

    A split before each such place leaves what follows the last one as its last part.
    """
    rest = F.element_at(F.split(body, f"(?={regex})", -1), -1)
    return F.when(body.rlike(regex), newlines(body) - newlines(rest))


def manifest_scan(files: DataFrame, rules: Iterable[Rule], path: str = "path", content: str = "content", before: int = 5, after: int = 4) -> DataFrame:
    """Multi-line rules of a manifest: a line is hit if the text from it to the end matches and so does the line
    or the lines around it; of the rules that hit a line the first wins.

    All inside the row, in time that is linear in the lines: the text from a line on matches if a match begins there or later,
    so one number a rule stands for all of these texts; and only lines up to the last of these numbers are looked at.
    """
    rules = list(rules)
    body = F.coalesce(F.col(content), F.lit(""))
    rows = files.select(path, F.split(body, "\n", -1).alias("_l"), F.array(*(last_start_line(body, r.patterns[0].regex) for r in rules)).alias("_last"))
    some = F.slice("_l", 1, F.coalesce(F.array_max("_last"), F.lit(-1)) + 1)
    # line by line, as a slice would copy the whole array for each line; what lies outside is null and left out
    near = lambda pos: F.array_join(F.array(*(F.get("_l", pos + d) for d in range(-before, after + 1))), "\n")
    lines = F.transform(some, lambda t, pos: F.struct(pos.alias("pos"), t.alias("t"), near(pos).alias("near")))

    def hit(x: Column) -> Column:
        out = F
        for i, r in enumerate(rules):
            regex = r.patterns[0].regex
            test = (x["pos"] <= F.get("_last", F.lit(i))) & (x["t"].rlike(regex) | ((x["pos"] > 0) & x["near"].rlike(regex)))
            out = out.when(test, F.lit(i))
        return F.struct(x["pos"].alias("pos"), (out if rules else F.lit(None).cast("int")).alias("rule"))

    named = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity")) for r in rules))
    hits = rows.select(path, F.explode(F.filter(F.transform(lines, hit), lambda x: x["rule"].isNotNull())).alias("h"))
    return hits.select(path, (F.col("h.pos") + 1).cast("long").alias("line"), F.get(named, F.col("h.rule")).alias("n")).select(path, "n.rule_id", "n.name", "n.severity", "line")
