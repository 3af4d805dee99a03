"""Session defaults, and shipping of this package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "siltworks", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; ``conf`` wins over them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan out to all cores where the files give fewer partitions than there are cores.

    For work that costs far more than moving its rows; a scan of many files stays as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Deals rows out to partitions of about ``rows`` each, so that a task's work and memory do not grow with the table.

    A small file may hold very many rows, and Spark cuts files by bytes. Costs a count of the table; a table that has
    enough partitions, or fits into one, stays as it is.
    """
    if df.isStreaming:
        return df
    parts = -(-df.count() // rows)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors once an application, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="siltworks-src-")
    path = os.path.join(folder, "siltworks-src.zip")
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
