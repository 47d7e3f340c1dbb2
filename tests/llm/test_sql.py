"""Every query of the training-data operators that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from spindrift.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            duck.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    want = sorted(map(repr, duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert got == want and got
