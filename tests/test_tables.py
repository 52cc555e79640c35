"""Every table query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from leafline.plans.table_queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def number(v: float):
    """pandas turns whole numbers into floats where a column has nulls."""
    return int(v) if float(v).is_integer() else round(float(v), 6)


def rows(df, columns):
    clean = lambda v: None if v is None or v is pd.NA or v != v else number(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr([clean(v) for v in r]) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, D).toPandas(), db.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
