"""Issues of any origin brought to one shape: message, severity, category, location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import severity

#: A range without an end has this many columns.
SPAN = 100


def first_text(*cols: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def _or_null(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).cast("string") for n in names]


def issues(raw: DataFrame) -> DataFrame:
    """Fills message, severity, category, suggestion and source from what an issue has; missing columns count as null.

    Empty texts count as missing, too; the category, its marks made spaces, serves as a message.
    """
    message, title, description, category, sev, suggestion, recommendation, source = _or_null(raw, "message", "title", "description", "category", "severity", "suggestion", "recommendation", "source")
    spoken = F.regexp_replace(F.nullif(category, F.lit("")), "[_-]", " ")
    return raw.withColumns(
        {
            "message": F.coalesce(first_text(message, title, description), spoken, F.lit("Code issue detected")),
            "severity": F.coalesce(first_text(sev), F.lit("medium")),
            "category": F.coalesce(first_text(category), F.lit("unknown")),
            "suggestion": first_text(suggestion, recommendation),
            "source": F.coalesce(first_text(source), F.lit("static")),
        }
    )


def with_message(df: DataFrame) -> DataFrame:
    """Drops issues without a message."""
    return df.filter(F.length("message") > 0)


def without_info(df: DataFrame, include_info: bool = False) -> DataFrame:
    return df if include_info else df.filter(~F.col("severity").eqNullSafe(F.lit("info")))


def location(df: DataFrame, structured: str = "location", line: str = "line", column: str = "column") -> Column:
    """struct<start_line, start_col, end_line, end_col>, lines from 0.

    ``structured`` is a struct<startLine, endLine, startColumn, endColumn> with lines from 1; where it is null the
    plain line and column count, and where those are null, too, the first line. Zero lines count as missing.
    """
    one = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
    low = lambda c: F.greatest(F.lit(0), c).cast("int")
    make = lambda a, b, c, d: F.struct(low(a).alias("start_line"), low(b).alias("start_col"), low(c).alias("end_line"), low(d).alias("end_col"))
    plain_line = F.col(line) if line in df.columns else F.lit(None).cast("int")
    plain_col = F.coalesce(F.col(column), F.lit(0)) if column in df.columns else F.lit(0)
    out = F.when(plain_line.isNotNull(), make(plain_line - 1, plain_col, plain_line - 1, low(plain_col) + SPAN)).otherwise(make(F.lit(0), F.lit(0), F.lit(0), F.lit(SPAN)))
    if structured not in df.columns:
        return out
    s = lambda f: F.col(f"{structured}.{f}")
    start_col = low(F.coalesce(s("startColumn"), F.lit(0)))
    whole = make(one(s("startLine")) - 1, start_col, one(F.coalesce(F.nullif(s("endLine"), F.lit(0)), s("startLine"))) - 1, F.when(s("endColumn").isNotNull(), low(s("endColumn"))).otherwise(start_col + SPAN))
    return F.when(F.col(structured).isNotNull(), whole).otherwise(out)


def diagnostics(raw: DataFrame) -> DataFrame:
    """Normalised issues with a message, their range and the level a diagnostic has."""
    df = with_message(issues(raw))
    return df.withColumn("range", location(df)).withColumn("level", severity.mapped(F.col("severity"), severity.DIAGNOSTIC, "Hint"))


def checked(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Adds ``invalid``: the first of the ``required`` columns (name to type) that is missing or does not have its type; null if all do."""
    expr = F
    for name, kind in required.items():
        if name not in df.columns:
            expr = expr.when(F.lit(True), f"{name} is missing")
        else:
            expr = expr.when(F.col(name).isNull(), f"{name} is missing").when(F.col(name).try_cast(kind).isNull(), f"{name} is not of type {kind}")
    return df.withColumn("invalid", expr.otherwise(F.lit(None).cast("string")))


def require(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """As ``checked``, but the first invalid row fails the query."""
    c = checked(df, required)
    return c.filter(F.when(F.col("invalid").isNotNull(), F.raise_error(F.col("invalid")).cast("boolean")).otherwise(True)).drop("invalid")


def defaulted(df: DataFrame, defaults: dict) -> DataFrame:
    """Every field of ``defaults`` that is missing or null gets its default."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in defaults.items()})
