"""Every registered query of the subpackage: against its SQL on the test
tables, or that it runs whole."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from outagekit.llm import queries

from .conftest import SF


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else float(f"{v:.9g}")
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in r) for r in df[cols].itertuples(index=False, name=None))


def test_all_operators_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert [q for q in names if q.startswith(f"op{n}_")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = E.queries()[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert _rows(got) == _rows(want)
