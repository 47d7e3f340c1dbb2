"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from spindrift.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) and math.isfinite(v) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in sql)


def test_row_index_of_nulls_equals_sql(spark, tmp_path):
    """Nulls in each column of the order, over several files and ranges; no two rows are equal there."""
    rows = [(None if i % 11 == 0 else i // 3, None if i % 13 == 0 else i, None if i % 7 == 0 else float(i % 5), i) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_shipdate int")
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    df.dropDuplicates(keys).repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = ["row_index", *keys, "l_shipdate"]
    got = QUERIES["row_index"](spark, str(tmp_path)).select(*columns).collect()
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['row_index']})").fetchall()
    assert len(got) > 900 and sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_plane_coordinates_equal_a_decomposition(spark, duck):
    """pca_2d against a decomposition of all vectors at once; an axis may point either way."""
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in rows], float)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    flat = u[:, :2] * s[:2]
    want = (flat - flat.min(axis=0)) / (flat.max(axis=0) - flat.min(axis=0)) * 100
    got = np.array([tuple(r)[1:] for r in QUERIES["pca_2d"](spark, FOLDER).orderBy("vec_id").select("vec_id", "x", "y").collect()])
    assert all(np.allclose(got[:, k], want[:, k], atol=1e-4) or np.allclose(got[:, k], 100 - want[:, k], atol=1e-4) for k in (0, 1))
