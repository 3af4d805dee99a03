"""Plugins as found in folders: a folder with a manifest is a plugin, a loose JSON file is a file of rules.

Folders come in classes by precedence: those of the settings, those that are delivered, those of the workspace, those of the
user. Of plugins with one id the first counts, by class and then by path; only so many are taken. A manifest that is
no JSON, or lacks its id, name or version, is invalid. Code is never loaded from a folder; a plugin's own
functions are registered (``operators.extension``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.operators import custom_rules

CLASSES = ("settings", "delivered", "workspace", "user")
MANIFEST = "plugin.json"
#: Fixed value: how many plugins are taken.
MOST = 50
_RULE = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in custom_rules._fields())}>"
SCHEMA = f"id string, name string, version string, displayName string, main string, contributes struct<rules:array<{_RULE}>>, _broken string"


def read_folders(spark: SparkSession, folders: dict[str, Sequence[str]]) -> DataFrame:
    """place (from 0), path, content of the manifests and rule files of the folders of each class; a folder that is not there
    is passed over."""
    out = spark.createDataFrame([], "place int, path string, content string")
    for place, name in enumerate(CLASSES):
        for folder in folders.get(name, ()):
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            system = where.getFileSystem(spark._jsc.hadoopConfiguration())
            for pattern in (f"{folder}/*/{MANIFEST}", f"{folder}/*.json"):
                if any(not s.isDirectory() for s in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or ()):
                    files = spark.read.option("wholetext", True).text(pattern)
                    out = out.unionByName(files.select(F.lit(place).alias("place"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return out.filter(F.col("path").endswith(f"/{MANIFEST}") | ~F.col("path").endswith(MANIFEST))


def manifests(files: DataFrame, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """``by``, place, path, id, name (the shown one), version, main, status, rules: one row a manifest, whose status is enabled, invalid,
    repeated (its id is taken already) or refused (there are ``most`` plugins before it).

    ``by`` tells users apart, each of whom has files of their own.
    """
    m = F.from_json("content", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = files.filter(F.substring_index("path", "/", -1) == MANIFEST).select(*by, "place", "path", m.alias("m"))
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    valid = F.coalesce(F.col("m._broken").isNull(), F.lit(True)) & has("m.id") & has("m.name") & has("m.version")
    rows = rows.withColumn("_valid", valid)
    nth = Window.partitionBy(*by, "_valid", "m.id").orderBy("place", "path")
    rows = rows.withColumn("_first", F.col("_valid") & (F.row_number().over(nth) == 1))
    before = F.sum(F.when(F.col("_first"), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("place", "path").rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(~F.col("_valid"), "invalid").when(~F.col("_first"), "repeated").when(before > most, "refused").otherwise("enabled")
    shown = F.when(has("m.displayName"), F.col("m.displayName")).otherwise(F.col("m.name"))
    rules = F.coalesce(F.col("m.contributes.rules"), F.array().cast(f"array<{_RULE}>"))
    return rows.select(*by, "place", "path", F.col("m.id").alias("id"), shown.alias("name"), F.col("m.version").alias("version"), F.col("m.main").alias("main"), status.alias("status"), rules.alias("rules"))


def contributed(plugins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rules that enabled plugins bring, switched on, with ``plugin``, ``valid`` and ``errors``."""
    rules = plugins.filter("status = 'enabled'").select(*by, F.col("id").alias("plugin"), F.posexplode("rules").alias("ord", "r")).select(*by, "plugin", "ord", "r.*")
    return custom_rules.validate(rules.withColumn("enabled", F.lit(True))).drop("warnings")
