"""Operator 1, quality rules: in-document counts and cross-document line frequency, native throughout.

Method: normalised lines are hashed, distinct documents are counted for each (host, line), lines over
the host's limit are removed, and documents depleted by that are rejected. The host is ``source``.

Edge cases: null text has no words and fails the base rule; a null host is a host of its own; repeated
rows (equal ``doc_id``) count as one document of a line; ties at the limit stay (only lines *over* it go);
a document without lines has nothing to lose and is judged by the base rule alone.

Scale: words never leave their row (higher-order functions on arrays), only line hashes are shuffled,
with map-side combining. The frequent lines are joined by shuffle, never broadcast by hint, because
their number grows with the corpus; the exchanges of that join can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import SPACE

WINDOW = 8
#: A line is boilerplate of its host when it is in more documents than both limits.
MIN_DOCS = 20
MAX_SHARE = 0.05
#: A document is depleted when less than this share of its line characters is left.
MIN_LEFT = 0.3
NOT_SPACE = r"[^\x20\x09-\x0D]"


def _normal(line: Column) -> Column:
    """Lower case, digit runs as 0, white space runs as one space, trimmed."""
    low = F.regexp_replace(F.lower(line), "[0-9]+", "0")
    return F.trim(F.regexp_replace(low, SPACE, " "))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_key and the counts of each text, all inside the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("\0null")).alias("host"), text.alias("text"))
    d = d.select(
        "doc_id",
        "host",
        F.xxhash64("host", "text").alias("text_key"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
    )
    d = d.select(
        "doc_id",
        "host",
        "text_key",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    base = ["doc_id", "host", "text_key", "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    at = F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
    grams = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + k) for k in range(WINDOW))))
    d = d.select(*base, F.when(F.col("n_words") >= WINDOW, grams).alias("grams"))
    # only a text with a repeated window goes on to the sort
    d = d.select(*base, F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")).alias("grams"))
    d = d.select(*base, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("s"))
    same = lambda x, k: F.coalesce(x["h"] == F.get(F.col("s"), k)["h"], F.lit(False))
    starts = F.transform("s", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    d = d.select(*base, F.array_sort(F.array_compact(starts)).alias("at"))
    widths = F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - i, F.lit(WINDOW))))
    covered = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*base, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def line_shares(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """text_key, left_share: the share of line characters that stays when boilerplate lines are removed.

    Equal texts of one host have equal shares, so the key is the hash of host and text; the share is a
    ratio of sums over the rows of that key and does not depend on how many rows there are.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col), F.lit("\0null")).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    hosts = d.groupBy("host").agg(F.count_distinct(F.struct("doc_id")).alias("host_docs"))
    lines = (
        d.select("doc_id", "host", F.xxhash64("host", "text").alias("text_key"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.col("line").rlike(NOT_SPACE))
        .select("doc_id", "host", "text_key", F.length("line").alias("chars"), F.xxhash64(_normal(F.col("line"))).alias("line_hash"))
    )
    often = (
        lines.groupBy("host", "line_hash")
        .agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"))
        .filter(F.col("n_docs") > min_docs)
        .join(hosts, "host")
        .filter(F.col("n_docs") > max_share * F.col("host_docs"))
        .select("host", "line_hash", F.lit(True).alias("often"))
    )
    return (
        lines.join(often, ["host", "line_hash"], "left")
        .groupBy("text_key")
        .agg((F.sum(F.when(F.col("often").isNull(), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("left_share"))
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Base counts, base verdict and the verdict of the line method for each document."""
    counts = document_counts(docs, id_col, text_col, host_col)
    shares = line_shares(docs, id_col, text_col, host_col, **limits)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.coalesce("left_share", F.lit(1.0))
    return counts.join(shares, "text_key", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= MIN_LEFT)).alias("kept"),
        F.round(left, 6).alias("left_share"),
    )


SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
ln AS (
  SELECT doc_id, host, length(line) AS chars,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, host, unnest(lines) AS line FROM w)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM w GROUP BY host),
often AS (
  SELECT l.host, l.norm FROM ln l JOIN hosts h ON l.host = h.host
  GROUP BY l.host, l.norm, h.host_docs
  HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > {MAX_SHARE} * h.host_docs),
sh AS (
  SELECT l.doc_id, sum(CASE WHEN o.norm IS NULL THEN chars ELSE 0 END) / sum(chars) AS left_share
  FROM ln l LEFT JOIN often o ON l.host = o.host AND l.norm = o.norm GROUP BY l.doc_id),
f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(left_share, 1.0)::DOUBLE AS left_share
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN sh ON w.doc_id = sh.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_share >= {MIN_LEFT} AS kept,
       round(left_share, 6) AS left_share
FROM f
"""
