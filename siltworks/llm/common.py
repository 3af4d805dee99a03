"""What the training-data operators share: reading tables, the shared work folder, and Arrow helpers.

Conventions that hold for every operator in this subpackage:

* Only the columns an operator names are read; any further column of the input, whatever its name,
  is ignored, so names cannot clash.
* A null text counts as the empty text unless an operator says otherwise; a null ``doc_id`` is a value
  like any other and comes back as null.
* Repeated rows give one result row each.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.session import ship

#: The word of all contracts: a maximal run without space, tab, line feed, vertical tab, form feed or return.
#: ``bytes.split()`` cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset (tests on one machine) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='siltworks-')}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OWN: dict[str, str] = {}
_PATHS: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    """Removes what this application wrote to the shared folder, as far as the session still lives."""
    for spark, path in _PATHS:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already at exit
            return


atexit.register(_sweep)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/siltworks/{label}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor then costs a re-read, not a recomputation, and a non-deterministic plan
    (range bounds, arrival order) is fixed once for all later reads.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def tidy(spark: SparkSession) -> None:
    """Gives the driver's free memory back, Python's and the JVM's; exchanges that nothing refers to any more go as well."""
    gc.collect()
    _give_back()
    spark._jvm.System.gc()


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, and lets Spark clean up the exchanges behind them.

    Only what later tables no longer need may go: they must be written themselves.
    """
    for df in tables:
        spark, path = df.sparkSession, df._written_to
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _PATHS[:] = [x for x in _PATHS if x[1] != path]
    if tables:
        tidy(tables[0].sparkSession)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty. No text is decoded."""
    col = batch.column(name)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return [x or b"" for x in col.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


#: What Spark hands to a Python task at once: bytes, beyond which a batch has one row.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"
#: Text bytes of a slice, beyond which it has one row.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of at most ``rows`` rows and ``most`` bytes of text; a longer text has its own slice."""
    size = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        kind = col.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def released(run: Callable) -> Callable:
    """A task function after which the worker, which Spark uses again, gives its free memory back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            _give_back()

    return task


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]], schema: str, rows: int = 512, most: int = SLICE_BYTES
) -> DataFrame:
    """``mapInArrow`` with state for each task: ``make()`` runs once a task and gives the batch function.

    Batches are cut to ``rows`` rows and ``most`` bytes of text, so what a step holds is bounded by those, or by
    one text where that is longer. What Spark hands over at once is bounded by ``BATCH_BYTES``, a setting of the session.
    """

    ship(df.sparkSession)
    df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            for part in slices(batch, rows, most):
                out = step(part)
                yield from out if isinstance(out, list) else [out]
        if step is not None and hasattr(step, "finish"):
            yield from step.finish()

    return df.mapInArrow(released(run), schema)


def smallest(df: DataFrame, keys: list[str], order: str, n: int, buckets: int = 16) -> DataFrame:
    """The ``n`` rows of each key with the smallest ``order`` (a hash), in two steps, so that no task ranks all rows of a key."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    some = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets))).withColumn("_r", rank(*keys, "_b")).filter(F.col("_r") <= n).drop("_r", "_b")
    return some.withColumn("_r", rank(*keys)).filter(F.col("_r") <= n).drop("_r")


def remainder(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
