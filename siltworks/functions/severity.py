"""Severity ranks and remaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and target names.
ORDER = ("critical", "high", "medium", "low", "info")
DIAGNOSTIC = {"critical": "Error", "high": "Error", "medium": "Warning", "low": "Information"}
SARIF = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
CLIMATE = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info"}
PENALTY = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 1}
UNKNOWN_PENALTY = 5


def mapped(col: Column, table: dict, default) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def rank(col: Column) -> Column:
    """0 for critical to 4 for info; an unknown severity is -1 and so sorts first."""
    return mapped(col, {s: i for i, s in enumerate(ORDER)}, -1)


def at_least(col: Column, least: str) -> Column:
    return rank(col) <= ORDER.index(least)


def score(severities: Column) -> Column:
    """100 less the summed penalties, not below 0; to be used in an aggregation."""
    total = F.sum(F.when(severities.isNotNull(), mapped(severities, PENALTY, UNKNOWN_PENALTY)).otherwise(0))
    return F.greatest(F.lit(0), 100 - F.coalesce(total, F.lit(0))).cast("long")
