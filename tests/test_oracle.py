"""Every registered query against its DuckDB twin on sf0.001 (the driver
runs the same comparison on sf0.01); queries without a twin must run."""

import os

import duckdb
import pytest

from tests.conftest import SF001
from tools.oracle_check import TABLES, rows_key

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "double": "DOUBLE"}


def duck_type(spark_type) -> str:
    name = spark_type.simpleString()
    if name.startswith("decimal"):
        return name.upper().replace(" ", "")
    return SPARK_TO_DUCK.get(name, name)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["pro_name", "total_sold"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return
    res = con.sql(ORACLE[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    dtypes = dict(zip(res.columns, (str(t) for t in res.types)))
    assert {f.name: duck_type(f.dataType) for f in df.schema.fields} == dtypes
    assert len(srows) == len(drows)
    assert rows_key(srows, df.columns) == rows_key(drows, res.columns)
