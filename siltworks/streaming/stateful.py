"""What the operators with keyed state share: one machine, run over the sorted rows of a table or over a stream.

A machine is fed rows (as dicts, in order) and gives rows. On a table the rows of a key are streamed through it, a batch at a
time, so that a key of any number of rows needs no more memory than its state; on a stream its state is kept between
micro-batches, with timers in event time where it has to act without a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltworks.session import ship

#: The store that timers and maps of states need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocksdb(spark: SparkSession) -> None:
    """The setting is the session's owner's to make (``siltworks.session`` does)."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}")


def over_table(rows: DataFrame, key: str, order: list, make: Callable[[], Callable[[dict], list[dict]]], schema: str) -> DataFrame:
    """Runs a fresh machine over the rows of each key in their order. A machine may have ``end()``, which gives what is left."""
    ship(rows.sparkSession)
    names = rows.columns
    types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, begun = None, None, False

        def given(out: list[dict]) -> list[pa.RecordBatch]:
            return [pa.RecordBatch.from_pylist(out, schema=types)] if out else []

        for batch in batches:
            out: list[dict] = []
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                row = dict(zip(names, values))
                if not begun or row[key] != now:
                    out += machine.end() if begun and hasattr(machine, "end") else []
                    machine, now, begun = make(), row[key], True
                out += machine(row)
            yield from given(out)
        if begun and hasattr(machine, "end"):
            yield from given(machine.end())

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def as_rows(pdf: pd.DataFrame, whole: tuple[str, ...]) -> list[dict]:
    """Rows with nulls as None; the columns in ``whole`` are whole numbers, which pandas makes fractions of beside nulls."""
    rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    for row in rows:
        row.update((c, int(row[c])) for c in whole if row[c] is not None)
    return rows


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))
