"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from tessera.plans.registry import load_all
from tools.oracle_check import duck, rows_of

from .conftest import SF_SMALL

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols, rows = df.columns, df.collect()
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert rows_of(cols, rows) == rows_of(ocols, orows)


FAST_ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES) - {
    "cv_regression_text", "oof_score_text", "test_inference_text", "classifier_bakeoff", "rfe_cv", "config_search", "trial_search"})


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
