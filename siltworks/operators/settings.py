"""Settings as rows: settings(profile, key, value, type) with the value as text and its type's name.

``type`` is string, number, boolean, array, object, or null where a key is not set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    key: str
    type: str
    default: str
    required: bool = False
    enum: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None


# The schema of settings.
SCHEMA = (
    Setting("apiEndpoint", "string", "http://localhost:3000/api/agents/dev-assistant", True),
    Setting("apiKey", "string", ""),
    Setting("analysisMode", "string", "full", True, ("quick", "deep", "full")),
    Setting("autoAnalyze", "boolean", "false", True),
    Setting("showInlineWarnings", "boolean", "true", True),
    Setting("enableDiagnostics", "boolean", "true", True),
    Setting("maxFileSize", "number", "50000", True, (), 1000, 500000),
    Setting("maxProjectFiles", "number", "40", True, (), 1, 200),
    Setting("maxProjectFileSize", "number", "120000", True, (), 1000, 1000000),
    Setting("requestTimeout", "number", "60000", True, (), 5000, 300000),
    Setting("enableTelemetry", "boolean", "true", True),
    Setting("cacheEnabled", "boolean", "true"),
    Setting("cacheTTL", "number", "1800000", False, (), 60000, 86400000),
    Setting("maxCacheSize", "number", "104857600", False, (), 10485760, 1073741824),
    Setting("retryEnabled", "boolean", "true"),
    Setting("maxRetries", "number", "3", False, (), 0, 10),
    Setting("retryDelay", "number", "1000", False, (), 100, 10000),
    Setting("logLevel", "string", "info", False, ("debug", "info", "warn", "error")),
    Setting("circuitBreakerEnabled", "boolean", "true"),
    Setting("circuitBreakerThreshold", "number", "5", False, (), 1, 20),
)
SECRET = "apiKey"
MASK = "[REDACTED]"


def schema_table(spark: SparkSession) -> DataFrame:
    rows = [(i, s.key, s.type, s.default, s.required, list(s.enum) or None, None if s.least is None else float(s.least), None if s.most is None else float(s.most)) for i, s in enumerate(SCHEMA)]
    return spark.createDataFrame(rows, "ord int, key string, want string, fallback string, required boolean, enum array<string>, least double, most double")


def _plain(x: Column) -> Column:
    """A bound without a trailing .0."""
    return x.cast("long").cast("string")


def validate(settings: DataFrame) -> DataFrame:
    """profile, key, kind (error or warning), message: for each key of the schema its first failure, and warnings.

    A key without a row counts as not set. One join with the schema, which has a fixed number of rows.
    """
    schema = schema_table(settings.sparkSession)
    every = settings.select("profile").distinct().join(F.broadcast(schema))  # profiles times the fixed schema
    rows = every.join(settings.select("profile", "key", "value", F.col("type").alias("has")), ["profile", "key"], "left")
    unset = F.col("has").isNull()
    number = F.col("value").try_cast("double")
    say = lambda *parts: F.concat(F.col("key"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    is_number = (F.col("want") == "number") & (F.col("has") == "number")
    error = (
        F.when(F.col("required") & (unset | (F.col("value") == "")), say(" is required but not set"))
        .when(unset, None)
        .when(F.col("has") != F.col("want"), say(" must be of type ", F.col("want")))
        .when(F.col("enum").isNotNull() & ~F.coalesce(F.array_contains("enum", F.col("value")), F.lit(False)), say(" must be one of: ", F.array_join("enum", ", ")))
        .when(is_number & (number < F.col("least")), say(" must be at least ", _plain(F.col("least")), " (current: ", F.col("value"), ")"))
        .when(is_number & (number > F.col("most")), say(" must be at most ", _plain(F.col("most")), " (current: ", F.col("value"), ")"))
        .when((F.col("key") == "apiEndpoint") & ~F.col("value").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "Invalid URL format: Invalid URL")
    )
    warning = F.when(error.isNull() & ~unset, F.when((F.col("key") == "apiEndpoint") & ~F.col("value").rlike("(?i)^https:"), "API endpoint should use HTTPS for security").when((F.col("key") == SECRET) & (F.trim("value") != ""), "Storing API key in settings is deprecated. Use SecretStorage instead."))
    both = rows.select("profile", "key", "ord", F.explode(F.array(F.struct(F.lit("error").alias("kind"), error.alias("message")), F.struct(F.lit("warning").alias("kind"), warning.alias("message")))).alias("r"))
    return both.select("profile", "key", "ord", "r.kind", "r.message").filter("message is not null")


def migrate(settings: DataFrame, from_version: str) -> DataFrame:
    """From version 1 on: the endpoint goes from http to https; two flags that are not set become true."""
    if not from_version.startswith("1."):
        return settings
    moved = settings.withColumn("value", F.when((F.col("key") == "apiEndpoint") & F.startswith(F.col("value"), F.lit("http:")), F.regexp_replace("value", "^http:", "https:")).otherwise(F.col("value")))
    flags = settings.select("profile").distinct().withColumn("key", F.explode(F.array(F.lit("cacheEnabled"), F.lit("retryEnabled"))))
    new = flags.join(settings.filter("type is not null").select("profile", "key"), ["profile", "key"], "left_anti")
    kept = moved.join(new, ["profile", "key"], "left_anti")
    return kept.unionByName(new.select("profile", "key", F.lit("true").alias("value"), F.lit("boolean").alias("type")))


def importable(settings: DataFrame) -> DataFrame:
    """Known keys only, never the secret."""
    return settings.filter(F.col("key").isin(*(s.key for s in SCHEMA if s.key != SECRET)))


def exported(settings: DataFrame) -> DataFrame:
    """The secret masked where it is set."""
    return settings.withColumn("value", F.when((F.col("key") == SECRET) & (F.length("value") > 0), MASK).otherwise(F.col("value")))


def defaults(spark: SparkSession, profile: str) -> DataFrame:
    return schema_table(spark).select(F.lit(profile).alias("profile"), "key", F.col("fallback").alias("value"), F.col("want").alias("type"))
