"""Text functions: hashes, redaction chains, escapes, templates, name and path clean-up."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the redaction chains, in their order.
DRIVE_PATH = r"[A-Za-z]:\\[^\s]+"
UNIX_PATH = r"/[^\s]+"
URL = r"https?://[^\s]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LONG_TOKEN = r"[a-zA-Z0-9]{32,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
KEY_VALUE = r"(?i)(password|secret|token|key)[\s:=]+[^\s]+"
ERROR_CHAIN = ((DRIVE_PATH, "[PATH]"), (UNIX_PATH, "[PATH]"), (LONG_TOKEN, "[REDACTED]"), (EMAIL, "[EMAIL]"), (IPV4, "[IP]"), (KEY_VALUE, "$1=[REDACTED]"))
TELEMETRY_CHAIN = ((DRIVE_PATH, "<path>"), (UNIX_PATH, "<path>"), (URL, "<url>"), (EMAIL, "<email>"), (LONG_TOKEN, "<token>"))
STACK_CHAIN = ((r"[a-zA-Z]:\\[^\s:]+", "<path>"), (r"/[^\s:]+", "<path>"))


def redact(col: Column, chain=ERROR_CHAIN) -> Column:
    """The chain's replacements one after the other; their order is part of the result."""
    for pattern, mask in chain:
        col = F.regexp_replace(col, pattern, mask)
    return col


def short_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def poly_hash(col: Column) -> Column:
    """The signed 32-bit polynomial hash of base 31 over UTF-16 code units, as lower-case hex of its absolute value."""
    wrap = lambda x: ((x + F.lit(2**31)) % F.lit(2**32) + F.lit(2**32)) % F.lit(2**32) - F.lit(2**31)
    units = F.regexp_extract_all(F.hex(F.encode(col, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + F.conv(c, 16, 10).cast("long")))
    return F.lower(F.hex(F.abs(h)))


def escape_html(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def escape_xml(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def escape_csv(col: Column) -> Column:
    """Quoted only where a comma, a quote or a line feed makes it necessary."""
    return F.when(col.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col)


def anonymize_path(col: Column) -> Column:
    parts = F.split(col, r"[/\\]")
    name = F.element_at(parts, -1)
    extension = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return F.concat(F.lit("<path-depth-"), F.size(parts).cast("string"), F.lit(">/<file>"), extension)


def looks_like_path(col: Column) -> Column:
    return col.rlike(r"[/\\]|^[~.]")


def clean_name(col: Column) -> Column:
    return F.regexp_replace(col, r"[^a-zA-Z0-9_.-]", "_")


def title_words(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def snippet(lines: Column, line: Column, before: int = 1, after: int = 2) -> Column:
    """The lines around a 1-based line of a text's ``lines``; line by line, as a slice would copy them all."""
    return F.array_join(F.array(*(F.get(lines, (line - 1 + d).cast("int")) for d in range(-before, after + 1))), "\n")


#: Longer input is cut after it is escaped.
INPUT_LIMIT = 200_000
# Replacements of the input sanitizer, in their order.
INPUT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"))


def sanitize_input(col: Column, limit: int = INPUT_LIMIT) -> Column:
    """Control characters go, markup is escaped, the rest is cut to the limit; null gives the empty text."""
    col = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x1F\x7F]", "")
    for raw, safe in INPUT_ESCAPES:
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return F.substring(col, 1, limit)


def replace_first(col: Column, old: Column, new: Column) -> Column:
    """The first exact occurrence of ``old`` replaced; unchanged where there is none."""
    at = F.position(old, col)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(col, F.lit(1), at - 1), new, F.substring(col, at + F.length(old), F.length(col)))).otherwise(col)


#: Fixed value: where a range ends that does not say in which column.
LAST_COLUMN = 999


def fixed(content: Column, original: Column, new: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """``new`` in place of the first exact occurrence of ``original``; where that is empty or not there, in place of the range
    (lines from 1, columns from 0; no end column, or 0, is the line's end). A range beyond the text ends with it, one that ends before it
    begins is turned round, and one without lines or without a new text changes nothing."""
    lines = F.split(content, "\n", -1)

    def offset(line: Column, column: Column) -> Column:
        before = F.length(F.array_join(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), "\n")) + F.when(line > 1, 1).otherwise(0)
        return F.when(line > F.size(lines), F.length(content)).otherwise(before + F.least(column, F.length(F.get(lines, line - 1))))

    a = offset(start_line, F.coalesce(start_column, F.lit(0)))
    b = offset(end_line, F.when(end_column > 0, end_column).otherwise(LAST_COLUMN))
    in_range = F.concat(F.substring(content, F.lit(1), F.least(a, b)), new, F.substring(content, F.greatest(a, b) + 1, F.length(content)))
    exact = (F.length(original) > 0) & (F.position(original, content) > 0)
    usable = (start_line >= 1) & (end_line >= 1)
    return F.when(~F.coalesce(F.length(new) > 0, F.lit(False)), content).when(F.coalesce(exact, F.lit(False)), replace_first(content, original, new)).when(F.coalesce(usable, F.lit(False)), in_range).otherwise(content)


def template(message: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by its value, the first occurrence of each name only; null counts as empty."""
    for name, value in values.items():
        message = replace_first(message, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return message


# Field names that tell of personal data.
PERSONAL = r"(?i)email|password|token|key|secret|username|user.*name|api.*key|auth|credential"


def anonymize_properties(props: Column) -> Column:
    """A flat map<string,string>: null values go, personal fields are masked, paths are anonymised."""
    kept = F.map_filter(props, lambda k, v: v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.when(k.rlike(PERSONAL), "[REDACTED]").when(looks_like_path(v), anonymize_path(v)).otherwise(v))


def anonymize_json(col: Column) -> Column:
    """The same for a JSON object of any depth (objects are followed, arrays stay as they are), in Arrow batches."""
    personal, path, cut = re.compile(PERSONAL), re.compile(r"[/\\]|^[~.]"), re.compile(r"[/\\]")

    def clean(value: dict) -> dict:
        out = {}
        for key, x in value.items():
            if x is None:
                continue
            if personal.search(key):
                x = "[REDACTED]"
            elif isinstance(x, str) and path.search(x):
                parts = cut.split(x)
                dot = parts[-1].rfind(".")
                x = f"<path-depth-{len(parts)}>/<file>{parts[-1][dot:] if dot >= 0 else ''}"
            elif isinstance(x, dict):
                x = clean(x)
            out[key] = x
        return out

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        return json.dumps(clean(value), separators=(",", ":"), ensure_ascii=False) if isinstance(value, dict) else text

    @F.pandas_udf("string")
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return batch(col)


def valid_token(col: Column) -> Column:
    """Three parts of base64url characters with dots between them."""
    return F.coalesce(col.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"), F.lit(False))


def token_expiry(col: Column) -> Column:
    """The number ``exp`` of the token's payload; null where there is none."""
    part = F.translate(F.split_part(col, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    body = F.try_to_binary(padded, F.lit("base64")).cast("string")
    raw = F.get_json_object(body, "$.exp")
    return F.when(F.regexp_like(body, F.lit(r'"exp"\s*:\s*-?[0-9]')), raw.try_cast("double"))


def token_expired(col: Column, now_seconds: Column) -> Column:
    """A token that is malformed, or has no number ``exp`` or a zero, counts as expired."""
    exp = token_expiry(col)
    return ~F.coalesce(valid_token(col) & (exp != 0) & ~(exp < F.floor(now_seconds)), F.lit(False))
