"""Order statistics by narrowing brackets against sorted values."""

import math
import random

import pytest

from outagekit.operators import quality as dq
from outagekit.operators import selection as SEL

QS = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


def columns() -> dict[str, list]:
    r = random.Random(3)
    n = 3000
    return {
        "even": [r.random() for _ in range(n)],
        "heavy tail": [math.exp(r.gauss(0, 4)) for _ in range(n)],
        "few values": [float(r.choice([0, 0, 0, 1, 2, 7])) for _ in range(n)],
        "one value": [5.0] * n,
        "a third alike": [1.5 if r.random() < 0.4 else r.gauss(0, 1) for _ in range(n)],
        "far ends": [r.choice([-1e300, 1e300, -math.inf, math.inf, 0.0, -0.0, r.random()]) for _ in range(n)],
        "not numbers": [math.nan if r.random() < 0.3 else r.random() for _ in range(n)],
        "few rows": [None if i % 100 else r.random() for i in range(n)],
    }


def by_sorting(values: list, q: float) -> float:
    real = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return real[SEL.nearest_rank(len(real), q)]


@pytest.mark.parametrize("few, accuracy", [(1_000_000, 10_000), (20, 100), (0, 10)])
def test_order_statistics(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(SEL, "FEW", few)
    monkeypatch.setattr(SEL, "ACCURACY", accuracy)
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` double" for c in data)).repartition(5)
    sizes = {}
    for c, values in data.items():
        real = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        sizes[c] = (len(real), real[0], real[-1])
    got = SEL.order_statistics(df, sizes, QS)
    for c, values in data.items():
        assert [repr(abs(v) if v == 0 else v) for v in got[c]] == [repr(abs(v) if v == 0 else v) for v in (by_sorting(values, q) for q in QS)], c


def test_outliers_alerts_and_top_of_small_columns(spark):
    rows = [(float(i % 10), 1.0, None) for i in range(99)] + [(500.0, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = dq.iqr_outliers(df, min_non_null=10)
    got = {r.coluna: (r.nao_nulos, r.outliers, r.outliers_inferiores, r.outliers_superiores, r.q1, r.q3) for r in out.collect()}
    assert got == {"a": (100, 1, 0, 1, 2.0, 7.0), "b": (100, 1, 0, 1, 1.0, 1.0)}
    assert tuple(dq.outlier_alerts(out, alert_pct=1.0).first()) == (2, 2, 0, 2)
    assert [r.coluna for r in dq.top_n(out, 1, [out.pct_outliers.desc(), out.coluna]).collect()] == ["a"]
    one = dq.iqr_outliers(df, min_non_null=1).where("coluna = 'c'").first()
    assert (one.nao_nulos, one.outliers, one.q1, one.desvio_padrao) == (1, 0, 3.0, None)
    none = dq.iqr_outliers(df.where("a < 0"), min_non_null=0)
    assert none.count() == 0 and none.dtypes == out.dtypes


def test_no_value_is_shuffled_but_the_last_bracket(spark, monkeypatch):
    """Of 40,000 different values a few hundred are ranked one by one."""
    from outagekit.operators import selection

    monkeypatch.setattr(SEL, "FEW", 1000)
    ranked, plain = [], selection.value_histogram
    monkeypatch.setattr(SEL, "value_histogram", lambda df, *a: ranked.append(df.count()) or plain(df, *a))
    df = spark.range(40_000).selectExpr("double(id * 7919 % 40009) / 3 as x")
    lo, hi = df.selectExpr("min(x)", "max(x)").first()
    assert SEL.order_statistics(df, {"x": (40_000, lo, hi)}, (0.25, 0.75)) == {
        "x": [by_sorting([r.x for r in df.collect()], q) for q in (0.25, 0.75)]}
    assert sum(ranked) <= 2 * 1000
