"""Worked examples from the reference's documentation and unit tests."""

import datetime as dt

from pyspark.sql import functions as F

from outagekit.operators import indicators as ind
from outagekit.operators import intervals as iv
from outagekit.operators import quality as dq


def T(h, m=0):
    return dt.datetime(2024, 1, 10, h, m)


def test_overlap_keeps_longest(spark):
    # UC 100: [10:00,12:00], [11:00,11:30], [13:00,15:00] -> 1st and 3rd kept
    rows = [("100", "1", T(10), T(12)), ("100", "2", T(11), T(11, 30)), ("100", "3", T(13), T(15))]
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    kept = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df).collect())
    assert kept == ["1", "3"]


def test_longer_later_interval_replaces_champion(spark):
    rows = [("1", "a", T(10), T(11)), ("1", "b", T(10, 30), T(14)), ("1", "c", T(13), T(13, 10))]
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    assert sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df).collect()) == ["b"]


def test_first_duplicate_kept(spark):
    # (100,10101), (100,10101), (100,10102) -> rows 1 and 3 kept
    rows = [("100", "10101", "r1", T(1)), ("100", "10101", "r2", T(2)), ("100", "10102", "r3", T(3))]
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_INIC_MANOBRA_UCI string, "
                                     "NUM_INTRP_UCI string, DTHR_INICIO_INTRP_UC timestamp_ntz")
    out = iv.dedup_first(df, ["NUM_UC_UCI", "NUM_INTRP_INIC_MANOBRA_UCI"], ["DTHR_INICIO_INTRP_UC", "NUM_INTRP_UCI"])
    assert sorted(r.NUM_INTRP_UCI for r in out.collect()) == ["r1", "r3"]


def test_null_check_counts_cells(spark):
    # {'a': [1, None], 'b': [2, 3]} -> failed 1, passed 3
    df = spark.createDataFrame([(1.0, 2), (None, 3)], "a double, b int")
    r = dq.null_check_summary(df).collect()[0]
    assert (r.failed, r.passed) == (1, 3)


def test_rule_report_keys_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c"), (4.0, "d")], "col1 double, col2 string")
    rep = {r.regra: r for r in dq.rule_report(df).collect()}
    assert {"null_check", "duplicate_check", "type_consistency"} <= set(rep)
    assert rep["null_check"].failed == 1
    assert rep["duplicate_check"].failed == 0


def test_dec_fec_identities(spark):
    unique = spark.createDataFrame(
        [("NRT", "1", "a", 60.0, "LIQUIDO"), ("NRT", "2", "b", 30.0, "EXPURGO"), ("CSL", "3", "c", 120.0, "LIQUIDO"),
         ("XXX", "4", "d", 10.0, "LIQUIDO")],
        "REGIONAL_TOTAL string, NUM_UC_UCI string, NUM_INTRP_PERCEBIDA string, DUR_MIN double, NATUREZA string")
    billed = spark.createDataFrame([("NRT", "L", "2024-01", 10.0), ("CSL", "P", "2024-01", 20.0)],
                                   "REGIONAL_TOTAL string, SIGLA_REGIONAL string, ANOMES string, UC_FATURADA double")
    t = {r.REGIONAL_TOTAL: r for r in ind.dec_fec(unique, billed).collect()}
    assert set(t) == {"NRT", "CSL", "COPEL"}          # unbilled region XXX drops out
    nrt = t["NRT"]
    assert nrt.CI_BRUTO == nrt.CI_LIQUIDO + nrt.CI_EXPURGO == 2
    assert abs(nrt.CHI_BRUTO - 1.5) < 1e-12
    assert abs(nrt.DEC_LIQUIDO - 1.0 / 10) < 1e-12 and abs(nrt.FEC_EXPURGO - 1 / 10) < 1e-12
    tot = t["COPEL"]
    assert tot.UC_FATURADA == 30.0 and tot.CI_BRUTO == 3
    assert abs(tot.DEC_BRUTO - round(3.5 / 30, 4)) < 1e-12
    # shares are over the sum of region ratios
    assert abs(t["NRT"].PCT_UC_FATURADA - 33.33) < 1e-9 and abs(t["CSL"].PCT_UC_FATURADA - 66.67) < 1e-9


def test_duration_stats_nearest_rank(spark):
    vals = [float(v) for v in range(1, 12)]  # 11 values, minutes 1..11
    u = spark.createDataFrame([("NRT", str(i), str(i), v, "LIQUIDO") for i, v in enumerate(vals)],
                              "REGIONAL_TOTAL string, NUM_UC_UCI string, NUM_INTRP_PERCEBIDA string, "
                              "DUR_MIN double, NATUREZA string")
    r = ind.duration_stats(u).collect()[0]
    assert r.QTD_INTRP == 11
    assert r.DUR_MEDIANA_H == round(6 / 60, 2)
    assert r.DUR_P95_H == round(11 / 60, 2)   # index round(10 * 0.95) = 10 -> 11 minutes
    assert r.DUR_MAX_H == round(11 / 60, 2)


def test_parse_flag_and_labels(spark):
    from outagekit.functions import scalars as S
    df = spark.createDataFrame([(" Sim ",), ("no",), (None,), ("1",)], "v string")
    assert [r[0] for r in df.select(S.parse_flag("v")).collect()] == [True, False, False, True]
    df2 = spark.createDataFrame([("  ",), ("l",), (None,)], "s string")
    assert [r[0] for r in df2.select(S.regional_label("s")).collect()] == ["SEM_SIGLA", "L", "SEM_SIGLA"]


def test_parse_year_month(spark):
    from outagekit.functions import scalars as S
    df = spark.createDataFrame([("2024-03",), ("2024/3",), ("03-2024",), ("202403",), ("2024_13",), ("x",)], "t string")
    ym = S.parse_year_month("t")
    got = [(r.a, r.m) for r in df.select(ym["ano"].alias("a"), ym["mes"].alias("m")).collect()]
    assert got == [(2024, 3)] * 4 + [(None, None)] * 2
