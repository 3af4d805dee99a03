"""Incremental analysis of document versions: scopes, line changes, what they affect, and findings carried over.

versions(uri, version, language, content). Scope detection and the line difference follow lines one by one, so
they run in Arrow batches, a document at a time; all else is joins on uri and version. Every side of a join grows with the
versions, and its size is underestimated (texts and exploded rows count as a few bytes), so joins are merges, never broadcasts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.plans.scopes import DEPENDENCIES, EXPORTS, SCOPE_KINDS, SCOPE_STARTS
from siltworks.session import dealt, ship

#: A change reaches this many lines beyond itself; a scope may move by less than this and be the same.
REACH, MOVE = 5, 5
SCOPE = "struct<type:string,name:string,start_line:int,end_line:int,hash:string>"
CHANGE = "struct<type:string,start_line:int,end_line:int,content:string,previous:string>"


def text_hash(content: str) -> str:
    return hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def scope_kind(line: str) -> str:
    return next((kind for regex, kind in SCOPE_KINDS if re.search(regex, line)), "block")


def find_scopes(content: str, language: str | None, compat: bool = False) -> list[tuple]:
    """(type, name, start, end, hash) of the scopes in the order in which they end, lines from 0.

    Braces close a scope; in python a line that is indented no more than the scope's first. A scope that does not
    end lasts to the last line; a text without scopes is one scope of type file. ``compat`` counts the braces of a
    first line twice, and ends python scopes where they begin.
    """
    lines = content.split("\n")
    starts = [re.compile(r, re.A) for r in SCOPE_STARTS.get(language or "", SCOPE_STARTS["javascript"])]
    python = language == "python"
    out: list[tuple] = []
    open_: list[list] = []  # kind, name, first line, depth, whether a brace was seen, indentation

    def close(last: int) -> None:
        kind, name, first, *_ = open_.pop()
        out.append((kind, name, first, last, text_hash("\n".join(lines[first : last + 1]))))

    for i, line in enumerate(lines):
        bare = line.strip()
        up, down = line.count("{"), line.count("}")
        indent = len(line) - len(line.lstrip())
        if python and not compat and bare:
            while open_ and indent <= open_[-1][5]:
                close(i - 1)
        found = next((m for m in (s.search(bare) for s in starts) if m), None)
        if found:
            open_.append([scope_kind(bare), found[1] or "anonymous", i, up if compat else 0, False, indent])
        if not open_:
            continue
        top = open_[-1]
        top[3] += up - down
        top[4] = top[4] or up > 0
        if compat:
            if top[3] <= 0 or (python and bare):
                close(i)
        elif not python:
            # a brace too many ends the scopes around as well
            while open_ and open_[-1][4] and open_[-1][3] <= 0:
                left = open_[-1][3]
                close(i)
                if left < 0 and open_:
                    open_[-1][3] += left
                else:
                    break
    while open_:
        close(len(lines) - 1)
    return out or [("file", "module", 0, len(lines) - 1, text_hash(content))]


def _shipped(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df


def scopes(versions: DataFrame, compat: bool = False) -> DataFrame:
    """uri, version, seq, type, name, start_line, end_line, hash, dependencies, exports."""

    names = ("type", "name", "start_line", "end_line", "hash")
    kind = pa.list_(pa.struct([(n, pa.int32() if n.endswith("line") else pa.string()) for n in names]))

    @F.arrow_udf(f"array<{SCOPE}>")
    def detect(content: pa.Array, language: pa.Array) -> pa.Array:
        # versions of a batch that are alike are looked at once
        places: dict[tuple, int] = {}
        at = [places.setdefault(x, len(places)) for x in zip(content.to_pylist(), language.to_pylist())]
        return pa.array([[dict(zip(names, s)) for s in find_scopes(c or "", g, compat)] for c, g in places], kind).take(pa.array(at, pa.int64()))

    rows = dealt(_shipped(versions)).withColumn("_lines", F.split(F.coalesce("content", F.lit("")), "\n", -1))
    rows = rows.select("uri", "version", "language", "_lines", F.posexplode(detect("content", "language")).alias("seq", "s"))
    rows = rows.select("uri", "version", "language", "seq", "s.*", F.array_join(F.slice("_lines", F.col("s.start_line") + 1, F.col("s.end_line") - F.col("s.start_line") + 1), "\n").alias("_text"))
    return rows.select("uri", "version", "seq", "type", "name", "start_line", "end_line", "hash", dependencies(F.col("_text"), F.col("language")).alias("dependencies"), exports(F.col("_text"), F.col("language")).alias("exports"))


def _extracted(code: Column, language: Column, table: dict) -> Column:
    out = F
    for name, regexes in table.items():
        out = out.when(language == name, F.concat(*(F.regexp_extract_all(code, F.lit(r), F.lit(1)) for r in regexes)))
    return out.otherwise(F.array().cast("array<string>"))


def dependencies(code: Column, language: Column) -> Column:
    return F.array_distinct(_extracted(code, language, DEPENDENCIES))


def exports(code: Column, language: Column) -> Column:
    """Names in a list with commas count one by one."""
    each = F.flatten(F.transform(_extracted(code, language, EXPORTS), lambda x: F.split(x, ",", -1)))
    return F.array_distinct(F.transform(each, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def _row(above: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences with one line of ``a`` more than ``above``."""
    out = np.zeros_like(above)
    out[1:] = np.maximum.accumulate(np.where(equal, above[:-1] + 1, above[1:]))
    return out


def common_lines(a: list[str], b: list[str]) -> list[str]:
    """The longest common subsequence; of several the one that a walk from the end finds that leaves lines of ``b``
    first where both ways are as long.

    Of the matrix of lengths only every k-th row is kept, k about the root of their number; the walk works out the rows
    between two of them again when it gets there. So memory is ``len(b)`` times that root, and time is twice the matrix.
    """
    names: dict[str, int] = {}
    x = np.array([names.setdefault(s, len(names)) for s in a], np.int32)
    y = np.array([names.setdefault(s, len(names)) for s in b], np.int32)
    every = max(1, math.isqrt(len(a)))
    row, kept = np.zeros(len(b) + 1, np.int32), []
    for i, line in enumerate(x):
        if i % every == 0:
            kept.append(row)
        row = _row(row, y == line)
    out, i, j, first = [], len(a), len(b), len(a) + 1
    rows: list[np.ndarray] = []
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
            continue
        if i - 1 < first:
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for line in x[first:i]:
                rows.append(_row(rows[-1], y == line))
        if rows[i - 1 - first][j] > rows[i - first][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def line_changes(old: str, new: str) -> list[tuple]:
    """(type, start, end, content, previous): insert, delete and replace regions; those of one type that touch are one."""
    a, b = old.split("\n"), new.split("\n")
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1  # equal ends are common in every walk from the end
    keep = common_lines(a[: len(a) - tail], b[: len(b) - tail]) + (a[len(a) - tail :] if tail else [])
    out: list[list] = []
    i = j = k = 0

    def put(kind: str, line: int, content: str, previous: str | None) -> None:
        last = out[-1] if out else None
        if last and last[0] == kind and line <= last[2] + 1:
            last[2] = max(last[2], line)
            last[3] += "\n" + content
            last[4] = f"{last[4]}\n{previous or ''}" if last[4] else previous
        else:
            out.append([kind, line, line, content, previous])

    while i < len(a) or j < len(b):
        old_kept = k < len(keep) and i < len(a) and a[i] == keep[k]
        new_kept = k < len(keep) and j < len(b) and b[j] == keep[k]
        if old_kept and new_kept:
            i, j, k = i + 1, j + 1, k + 1
        elif old_kept or i >= len(a):
            put("insert", j, b[j] if j < len(b) else "", None)
            j += 1
        elif new_kept or j >= len(b):
            put("delete", i, "", a[i])
            i += 1
        else:
            put("replace", j, b[j], a[i])
            i, j = i + 1, j + 1
    return [tuple(x) for x in out]


def with_previous(versions: DataFrame) -> DataFrame:
    """Adds ``previous``, the content of the version before, null for the first."""
    return versions.withColumn("previous", F.lag("content").over(Window.partitionBy("uri").orderBy("version")))


def changes(versions: DataFrame) -> DataFrame:
    """uri, version, type, start_line, end_line, content, previous: against the version before; none for the first."""

    @F.pandas_udf(f"array<{CHANGE}>")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([[dict(zip(("type", "start_line", "end_line", "content", "previous"), c)) for c in line_changes(o or "", n or "")] for o, n in zip(old, new)])

    rows = with_previous(_shipped(versions)).filter(F.col("previous").isNotNull() & ~F.col("previous").eqNullSafe(F.col("content")))
    return rows.select("uri", "version", F.explode(compare("previous", "content")).alias("c")).select("uri", "version", "c.*")


def merged(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Neighbours of one type in the list of a key (by ``order``) made one where they touch; a region of another type between
    two keeps them apart. Keys, type, start_line (of the first), end_line (the last line of all), n; and where they are given,
    content and previous, joined line by line.

    Islands in two steps: stretches of one type, and within each those that begin beyond all lines before. A stretch's lines
    before a gap all lie before it, so the last line of all before is that of the island.
    """
    listed = Window.partitionBy(*keys).orderBy(*order)
    turn = F.when(F.lag("type").over(listed).eqNullSafe(F.col("type")) & (F.row_number().over(listed) > 1), 0).otherwise(1)
    rows = found.withColumn("_turn", turn).withColumn("_stretch", F.sum("_turn").over(listed.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    reach = F.max("end_line").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", F.when(F.col("start_line") > reach + 1, 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_gap").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    texts = [c for c in ("content", "previous") if c in found.columns]
    # a previous text is joined once there is one before it
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, *texts))), lambda r: F.struct(*(r[c].alias(c) for c in texts))) if texts else None
    out = rows.groupBy(*keys, "_stretch", "_island").agg(
        F.first("type").alias("type"), F.min_by("start_line", place).alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n"), *([lines.alias("_lines")] if texts else [])
    )
    made = []
    if "content" in texts:
        made.append(F.array_join(F.transform("_lines", lambda r: F.coalesce(r["content"], F.lit(""))), "\n").alias("content"))
    if "previous" in texts:
        add = lambda before, r: F.when(before != "", F.concat(before, F.lit("\n"), F.coalesce(r["previous"], F.lit("")))).otherwise(r["previous"])
        made.append(F.aggregate("_lines", F.lit(None).cast("string"), add).alias("previous"))
    return out.select(*keys, "type", "start_line", "end_line", "n", *made)


def match_previous(found: DataFrame, before: DataFrame) -> DataFrame:
    """Each scope with the hash of the first scope before it that has its name and begins near; null without one."""
    b = before.select(*(F.col(c).alias(f"_{c}") for c in ("uri", "version", "name", "start_line", "seq", "hash")))
    near = (F.col("uri") == F.col("_uri")) & (F.col("version") == F.col("_version")) & (F.col("name") == F.col("_name")) & (F.abs(F.col("start_line") - F.col("_start_line")) < MOVE)
    first = found.select("uri", "version", "seq", "name", "start_line").join(b.hint("merge"), near).groupBy("uri", "version", "seq").agg(F.min_by(F.struct(F.col("_hash").alias("hash"), F.col("_start_line").alias("start_line")), "_seq").alias("p"))
    return found.join(first.select("uri", "version", "seq", F.col("p.hash").alias("previous_hash"), F.col("p.start_line").alias("previous_start")).hint("merge"), ["uri", "version", "seq"], "left")


def previous_scopes(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Scopes under the number of the version that follows theirs."""
    after = versions.select("uri", "version", F.lead("version").over(Window.partitionBy("uri").orderBy("version")).alias("_next"))
    return found.join(after.hint("merge"), ["uri", "version"]).filter("_next is not null").withColumn("version", F.col("_next")).drop("_next")


def affected(versions: DataFrame, found: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """The scopes of each version with ``status``: affected (changed, near a change, or using an affected one) or unchanged.

    All scopes of a first version are affected; those of a version like the one before are unchanged.
    """
    found = scopes(versions, compat) if found is None else found
    diff = changes(versions)
    olds = with_previous(versions).select("uri", "version", F.col("previous").isNull().alias("_first"), F.col("previous").eqNullSafe(F.col("content")).alias("_same"))
    rows = match_previous(found, previous_scopes(found, versions)).join(olds.hint("merge"), ["uri", "version"])
    c = diff.select(F.col("uri").alias("_u"), F.col("version").alias("_cv"), (F.col("start_line") - REACH).alias("_from"), (F.col("end_line") + REACH).alias("_to"))
    near = (F.col("uri") == F.col("_u")) & (F.col("version") == F.col("_cv")) & (F.col("_from") <= F.col("end_line")) & (F.col("_to") >= F.col("start_line"))
    touched = rows.join(c.hint("merge"), near, "left_semi").select("uri", "version", "seq", F.lit(True).alias("_touched"))
    rows = rows.join(touched.hint("merge"), ["uri", "version", "seq"], "left")
    direct = F.coalesce("_touched", F.lit(False)) | F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("hash"))
    rows = rows.withColumn("_direct", F.when(F.col("_first"), True).when(F.col("_same"), False).otherwise(direct))
    names = rows.filter("_direct").groupBy("uri", "version").agg(F.collect_set("name").alias("_names"))
    rows = rows.join(names.hint("merge"), ["uri", "version"], "left")
    used = ~F.col("_same") & F.coalesce(F.arrays_overlap("dependencies", "_names"), F.lit(False))
    return rows.withColumn("status", F.when(F.col("_direct") | used, "affected").otherwise("unchanged")).drop("_first", "_same", "_touched", "_direct", "_names")


def _names(code: str, language: str | None, table: dict) -> list[str]:
    return [x for regex in table.get(language or "", ()) for x in re.findall(regex, code, re.A)]


def scope_status(previous: tuple[str, list[tuple]] | None, content: str, language: str | None, found: list[tuple]) -> list[str]:
    """affected or unchanged for each scope of a version, as ``affected`` gives it, from the content and the scopes of the
    version before (None for a first one): for states that keep one version of a document."""
    if previous is None:
        return ["affected"] * len(found)
    before, olds = previous
    if before == content:
        return ["unchanged"] * len(found)
    regions = [(c[1] - REACH, c[2] + REACH) for c in line_changes(before, content)]
    lines = content.split("\n")
    direct = []
    for _, name, start, end, digest in found:
        old = next((o for o in olds if o[1] == name and abs(o[2] - start) < MOVE), None)
        direct.append(old is None or old[4] != digest or any(a <= end and b >= start for a, b in regions))
    names = {s[1] for s, d in zip(found, direct) if d}
    used = [bool(names.intersection(_names("\n".join(lines[s[2] : s[3] + 1]), language, DEPENDENCIES))) for s in found]
    return ["affected" if d or u else "unchanged" for d, u in zip(direct, used)]


def carried_over(status: DataFrame, findings: DataFrame, versions: DataFrame) -> DataFrame:
    """Findings(uri, version, name, start_line, finding) of earlier versions that still hold: through every later version in
    which a scope of that name and first line is unchanged, up to the first in which it is not, or is not there.

    The versions in which a scope is unchanged are islands of numbers that follow each other; a finding reaches the
    rest of the island that begins right after its version, or holds it.
    """
    numbered = versions.select("uri", "version").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("uri").orderBy("version")))
    scope = ["uri", "name", "start_line"]
    same = status.filter("status = 'unchanged'").select(*scope, "version").distinct().join(numbered.hint("merge"), ["uri", "version"])
    islands = same.withColumn("_i", F.col("_n") - F.row_number().over(Window.partitionBy(*scope).orderBy("_n")))
    held = findings.join(numbered.hint("merge"), ["uri", "version"]).withColumn("_n", F.col("_n") + 1).drop("version").distinct()
    # the island that a finding comes to, and its versions from there on
    first = held.join(islands.drop("version").hint("merge"), [*scope, "_n"])
    rest = islands.select(*scope, "version", "_i", F.col("_n").alias("_at"))
    return first.join(rest.hint("merge"), [*scope, "_i"]).filter("_at >= _n").drop("_n", "_i", "_at").distinct()


def coverage(status: DataFrame, versions: DataFrame) -> DataFrame:
    """uri, version, analyzed (lines of affected scopes; nested ones count each), skipped, percent."""
    done = status.filter("status = 'affected'").groupBy("uri", "version").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("analyzed"))
    rows = versions.select("uri", "version", F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("_n")).join(done.hint("merge"), ["uri", "version"], "left")
    n = F.coalesce("analyzed", F.lit(0))
    return rows.select("uri", "version", n.alias("analyzed"), (F.col("_n") - n).alias("skipped"), F.round(n / F.col("_n") * 100, 6).alias("percent"))
