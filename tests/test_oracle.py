"""Every SQL-expressible registered query equals its DuckDB twin (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, coarse, digest
from tests.conftest import SF0001

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF0001)
    rel = con.sql(E.oracle_sql()[name])
    s_types = {f.name: coarse(f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = {c: coarse(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert s_types == d_types
    hs, _ = digest(sdf.toPandas())
    hd, _ = digest(rel.df())
    assert hs == hd


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) >= {"model", "rmse_mean", "r2_mean"}
