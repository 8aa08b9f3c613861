"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from lodestar.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows(df):
    show = lambda x: "" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x).replace(" 00:00:00", "")
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) > 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert {k: KINDS[v] for k, v in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.toPandas()) == rows(want.df())
