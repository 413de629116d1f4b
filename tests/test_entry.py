"""Driver contract: entry() smoke, and every query against its DuckDB oracle on sf0.001."""

import math

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from opsrisk.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["alert_id", "workflow_id", "severity", "type", "message", "recommended_action", "generated_at"]


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v).replace("T", " ") if hasattr(v, "isoformat") else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


SKIP_SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - SKIP_SLOW))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
