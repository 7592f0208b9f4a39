"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from outagekit.plans import catalog
from outagekit.sources.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in E.queries().items() if k in catalog.QUERIES}
ORACLES = catalog.ORACLES


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in rec) for rec in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert not rows_only
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(df.columns) == 21 and len(rows) >= 1
    assert rows[-1].REGIONAL_TOTAL == "COPEL"



@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_billed_rollup_total_is_sum_of_regions(spark):
    df = QUERIES["billed_uc_rollup"](spark, SF).toPandas()
    for _, g in df.groupby("ANOMES"):
        tot = g[g.REGIONAL_TOTAL == "COPEL"].UC_FATURADA.sum()
        assert tot == g[g.REGIONAL_TOTAL != "COPEL"].UC_FATURADA.sum()
