"""The SQL twins of this subpackage's queries."""

import duckdb
import pytest

from scripts.oracle_check import TABLES, coarse, digest
from tests.conftest import SF0001
from trellis.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF0001), con.sql(ORACLES[name])
    assert {f.name: coarse(f.dataType.simpleString()) for f in df.schema.fields} == {
        c: coarse(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert digest(df.toPandas())[0] == digest(rel.df())[0]
