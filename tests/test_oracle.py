"""Every registered query with oracle SQL equals DuckDB on the same parquet tables."""

import duckdb
import pytest

import __spark_entry__ as E
from sessionlens.plans.catalog import QUERIES as CATALOG
from tools.oracle_check import TABLES, rows_of

from .conftest import SF_SMALL

ORACLE = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(ORACLE[name]).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["session_id", "block_id", "timestamp", "timestamp_start", "timestamp_end", "n_events",
                          "label"]


def test_every_query_has_oracle_or_is_a_model():
    models = {"gbt_calibrated", "svd_scores", "linear_ae", "stacker", "score_batch", "log_alerts", "dense_ae"}
    assert set(CATALOG) - set(ORACLE) == models
    assert set(CATALOG) <= set(E.queries())
