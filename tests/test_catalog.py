"""The catalogue's queries against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from dqlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, db, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
