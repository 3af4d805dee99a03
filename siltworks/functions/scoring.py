"""Scores of findings: confidence, likelihood of a false positive, priority, backoff, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRANSIENT = ("network", "timeout", "econnrefused", "enotfound", "etimedout", "rate limit", "429", "500", "502", "503", "504")
DOUBTFUL = ("test", "mock", "example", "sample", "placeholder", "demo", "todo", "fixme")


def confidence(match: Column, severity: Column) -> Column:
    """0.7, more for long matches and grave severities, at most 1."""
    more = F.when(F.length(match) > 50, 0.1).otherwise(0.0) + F.when(F.length(match) > 100, 0.1).otherwise(0.0)
    grave = F.when(severity == "critical", 0.1).when(severity == "high", 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.7) + more + grave), 6)


def false_positive(match: Column, patterns: Column | tuple = ()) -> Column:
    """0.2, and 0.1 for each doubtful word in the match, 0.15 for each pattern of the rule (regexes, or a column of arrays of them), at most 0.9."""
    low, total = F.lower(match), F.lit(0.2)
    for word in DOUBTFUL:
        total = total + F.when(F.contains(low, F.lit(word)), 0.1).otherwise(0.0)
    if isinstance(patterns, Column):
        return F.round(F.least(total + 0.15 * F.size(F.filter(patterns, lambda r: F.rlike(match, r))), F.lit(0.9)), 6)
    for regex in patterns:
        total = total + F.when(match.rlike(f"(?i){regex}"), 0.15).otherwise(0.0)
    return F.round(F.least(total, F.lit(0.9)), 6)


def epss_band(epss: Column) -> Column:
    """Bands of an exploit probability by its rounded percentage: 75, 50 and 25."""
    percent = half_up(epss * 100)
    return F.when(percent >= 75, "CRITICAL").when(percent >= 50, "HIGH").when(percent >= 25, "MEDIUM").when(percent.isNotNull(), "LOW")


# The types of errors, and what tells them, tried in this order.
ERROR_TYPES = ("NETWORK_ERROR", "TIMEOUT_ERROR", "AUTH_ERROR", "VALIDATION_ERROR", "RATE_LIMIT_ERROR", "SERVER_ERROR", "CONFIGURATION_ERROR", "CACHE_ERROR", "UNKNOWN_ERROR")
_TELLING = (
    (0, ("network", "econnrefused", "enotfound")), (1, ("timeout", "etimedout")), (4, ("rate limit", "429")), (5, ("500", "502", "503", "504")),
    (2, ("401", "403", "unauthorized")), (3, ("400", "validation")), (6, ("config",)), (7, ("cache",)),
)


def error_type(message: Column) -> Column:
    """The type of an error by its message."""
    low, expr = F.lower(message), F
    for at, words in _TELLING:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        expr = expr.when(test, ERROR_TYPES[at])
    return expr.otherwise(ERROR_TYPES[-1])


def backoff(attempt: Column, first: float = 1000.0, factor: float = 2.0, most: float = 30000.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def half_up(x: Column) -> Column:
    """Rounding with halves up, toward positive infinity."""
    return F.floor(x + 0.5).cast("long")


def retryable(message: Column) -> Column:
    low = F.lower(message)
    expr = F.lit(False)
    for word in TRANSIENT:
        expr = expr | F.contains(low, F.lit(word))
    return expr


def compare(value: Column, op: Column, threshold: Column) -> Column:
    return F.when(op == "gt", value > threshold).when(op == "gte", value >= threshold).when(op == "lt", value < threshold).when(op == "lte", value <= threshold).when(op == "eq", value == threshold).otherwise(False)
