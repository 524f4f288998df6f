"""Registered queries with SQL against DuckDB on the smallest tables."""

import pytest

from tessera.llm.registry import load_all
from tests.conftest import SF_SMALL
from tools.oracle_check import duck, rows_of

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    cur = duck(SF_SMALL).execute(ORACLES[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert rows_of(df.columns, rows) == rows_of(columns, want)
