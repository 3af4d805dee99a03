"""Every query with SQL against DuckDB; the others run and have a stable schema."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted("|".join(cell(x) for x in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, con, name):
    got = engine.QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in engine.SQL:
        want = con.sql(engine.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


@pytest.mark.parametrize("rows", ["none", "nulls and repeats"])
def test_poor_tables(spark, sf, tmp_path_factory, rows):
    """Every query runs over tables without rows, and over tables with repeated rows and rows of nulls."""
    path = str(tmp_path_factory.mktemp("poor"))
    for t in TABLES:
        some = spark.read.parquet(f"{sf}/{t}.parquet").limit(0 if rows == "none" else 25)
        nulls = some.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema.fields)).limit(2)
        some.unionByName(some.limit(5)).unionByName(nulls).coalesce(1).write.parquet(f"{path}/{t}.parquet")
    for name, run in engine.QUERIES.items():
        got = run(spark, path)
        assert len(set(got.columns)) == len(got.columns), name
        got.write.format("noop").mode("overwrite").save()
