"""Null keys, exact sums, back-filled ids, partitions and per-input results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outagekit.functions import scalars as S
from outagekit.operators import indicators as ind
from outagekit.operators import intervals as iv
from outagekit.operators import quality as dq
from outagekit.plans import catalog
from outagekit.session import checkpoint_dir
from outagekit.sources import io as sio

SF_SMALL = "/root/testdata/sf0.001"

START = dt.datetime(2024, 1, 1)
RAW = "NUM_UC_UCI string, NUM_INTRP_UCI string, DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz, mes int, peso bigint"


def intervals(spark, n=60):
    rows = []
    for i in range(n):
        begin = START + dt.timedelta(minutes=7 * (i % 20), seconds=i)
        end = begin + dt.timedelta(minutes=(i * 5) % 23) if i % 9 else None
        rows.append((["a", None, "b"][i % 3], str(i), begin, end, [1, None][i % 2], (1 << 53) + 1 + i if i % 4 else None))
    return spark.createDataFrame(rows, RAW)


def as_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_marks_do_not_depend_on_the_path_with_null_keys(spark):
    df = intervals(spark)
    off = as_rows(iv.mark_overlaps(df, scope=["mes"], skew="off"))
    assert off == as_rows(iv.mark_overlaps(df, scope=["mes"], skew="on"))
    assert off == as_rows(iv.mark_overlaps(df, scope=["mes"], skew="auto", hot_rows=5))


def test_resolution_does_not_depend_on_the_path_and_keeps_values(spark):
    df = intervals(spark)
    off = as_rows(iv.resolve_overlaps(df, skew="off"))
    assert off == as_rows(iv.resolve_overlaps(df, skew="on"))
    assert off == as_rows(iv.resolve_overlaps(df, skew="auto", hot_rows=5))
    all_rows = set(as_rows(df))
    assert set(off) <= all_rows  # no value changed, none lost
    assert len(off) < df.count()


def test_resolution_streams_across_batches(spark):
    df = intervals(spark, 200)
    want = as_rows(iv.resolve_overlaps(df))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert as_rows(iv.resolve_overlaps(df)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_the_callers_hot_keys_are_used(spark):
    df = intervals(spark)
    hot = spark.createDataFrame([(None, 20)], "NUM_UC_UCI string, __n long")
    assert as_rows(iv.mark_overlaps(df, hot=hot)) == as_rows(iv.mark_overlaps(df, skew="off"))


class _Context:
    def __init__(self, master, path=None):
        self.master, self.path = master, path

    def getCheckpointDir(self):
        return self.path

    def setCheckpointDir(self, path):
        self.path = path


class _Session:
    def __init__(self, context):
        self.sparkContext = context


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(_Context("spark://host:7077")))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(_Context("local-cluster[2,1,1024]")))
    assert checkpoint_dir(_Session(_Context("spark://host:7077", "hdfs://x/y"))) == "hdfs://x/y"
    assert checkpoint_dir(_Session(_Context("local[2]")))


def test_customer_hours_beyond_a_bigint_of_microseconds(spark):
    hours = 3.0e6
    unique = spark.range(2000).select(F.lit("NRT").alias("REGIONAL_TOTAL"), F.lit("LIQUIDO").alias("NATUREZA"),
                                      F.lit(hours * 60).alias("DUR_MIN"))
    assert ind.ci_chi(unique).first().CHI_HORAS == hours * 2000  # 6e9 h, 2.16e19 us
    billed = spark.createDataFrame([("NRT", "L", "2024-03", 100.0)], "REGIONAL_TOTAL string, SIGLA_REGIONAL string, ANOMES string, UC_FATURADA double")
    assert {r.REGIONAL_TOTAL: r.CHI_BRUTO for r in ind.dec_fec(unique, billed).collect()} == {"NRT": 6e9, "COPEL": 6e9}
    rows = spark.range(2000).select(F.lit("L").alias("SIGLA_REGIONAL"), F.lit(hours * 60).alias("DURACAO_PERCEBIDA_MINUTOS"),
                                    F.lit(2.5).alias("QTD_UC_AFETADA"))
    assert ind.ci_chi_preview(rows).first().CHI_horas == hours * 2000 * 2.5


def test_rows_with_a_filled_id_count_in_the_indicators(spark):
    rows = [("u1", None, "m1", "L", "0", START, START + dt.timedelta(hours=1), 60.0, True),
            ("u2", "p2", "m2", "L", "0", START, START + dt.timedelta(hours=2), 120.0, True)]
    marked = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_PERCEBIDA string, NUM_INTRP_INIC_MANOBRA_UCI string, SIGLA_REGIONAL string, "
                                         "TIPO_PROTOC_JUSTIF_UCI string, DTHR_INICIO_INTRP_PERCEBIDO timestamp_ntz, DATA_HORA_FIM_INTR_PERCEBIDO timestamp_ntz, "
                                         "DURACAO_PERCEBIDA_MINUTOS double, verificado boolean")
    billed = spark.createDataFrame([("NRT", "L", "2024-01", 10.0)], "REGIONAL_TOTAL string, SIGLA_REGIONAL string, ANOMES string, UC_FATURADA double")
    total = lambda m: ind.dec_fec(ind.consolidate_perceived(ind.eligible_rows(m, "2024-01", billed)), billed).collect()[-1]
    assert (total(marked).CI_BRUTO, total(marked).CHI_BRUTO) == (1.0, 2.0)
    filled = S.backfill_perceived(marked)
    assert (total(filled).CI_BRUTO, total(filled).CHI_BRUTO) == (2.0, 3.0)


def test_a_rerun_replaces_the_month_partition(spark, tmp_path):
    df = intervals(spark).drop("mes")
    target = str(tmp_path / "raw")
    sio.write_month_partition(df, target, "DTHR_INICIO_INTRP_UC")
    assert (tmp_path / "raw" / "ano=2024" / "mes=01").is_dir()
    sio.write_month_partition(df.limit(4), target, "DTHR_INICIO_INTRP_UC")
    assert spark.read.parquet(target).count() == 4


def test_an_unrelated_ano_and_mes_do_not_filter(spark):
    m = catalog.marked_long(spark, SF_SMALL)
    b = catalog.billed(spark, SF_SMALL)
    plain = ind.eligible_rows(m, catalog.ANOMES, b).count()
    other = m.withColumn("ano", F.lit(1999)).withColumn("mes", F.lit(None).cast("int"))
    assert ind.eligible_rows(other, catalog.ANOMES, b).count() == plain > 0


def test_the_stored_flagship_prunes_at_the_scan(spark, tmp_path):
    target = sio.write_month_partition(catalog.marked_long(spark, SF_SMALL), str(tmp_path / "marked"), "DTHR_INICIO_INTRP_UC")
    b = catalog.billed(spark, SF_SMALL)
    out = ind.dec_fec(ind.consolidate_perceived(ind.eligible_rows(spark.read.parquet(target), catalog.ANOMES, b, ("ano", "mes"))), b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "PERCEBID" in line)
    assert "PartitionFilters: [" in scan and "ano" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(DTHR_INICIO_INTRP_PERCEBIDO" in plan


def test_missing_columns_stop_the_import_chain(spark):
    raw = intervals(spark).drop("mes", "peso")
    for f in (iv.import_processing, iv.processing_report):
        with pytest.raises(KeyError, match="manoeuvre"):
            f(raw)
        with pytest.raises(KeyError, match="consumer"):
            f(raw.drop("NUM_UC_UCI"))


def test_an_unreadable_input_is_reported_beside_the_others(spark, tmp_path):
    intervals(spark).drop("mes").write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_text("not parquet")
    marked, summary = iv.mark_inputs(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert {r.arquivo[-9:]: (r.status, r.total) for r in summary.collect()} == {"a.parquet": ("ok", 60), "b.parquet": ("erro", 0)}
    assert marked.count() == 60
    both = dq.schema_check_inputs(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], catalog.TEXT_CONTRACT)
    assert {r.status for r in both.collect()} == {"colunas_ausentes", "erro"}


def test_iqr_with_a_small_minimum(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    want = con.execute(catalog._iqr_sql(["event_id", "user_id", "value"], min_non_null=10)).df().set_index("coluna")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for skew in ("auto", "on"):
        got = dq.iqr_outliers(events, min_non_null=10, skew=skew).toPandas().set_index("coluna")
        assert len(got) == 3
        assert (got[want.columns].loc[want.index] == want).all().all()


def test_alerts_and_top_outliers_over_columns_with_outliers(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "value")
    result = dq.iqr_outliers(events, min_non_null=10)
    rows = sorted(result.collect(), key=lambda r: (-r.pct_outliers, r.coluna))
    assert rows[0].coluna == "value" and rows[0].pct_outliers >= 1.0 and len(rows) == 3
    for top in (1, 2, 30):
        alert = dq.outlier_alerts(result, top_n=top).first()
        assert alert.colunas_analisadas == 3
        assert alert.colunas_em_alerta == sum(r.pct_outliers >= 1.0 for r in rows)
        assert alert.inferiores_top == sum(r.outliers_inferiores for r in rows[:top])
        assert alert.superiores_top == sum(r.outliers_superiores for r in rows[:top]) > 0
        best = dq.top_n(result, top, [F.col("pct_outliers").desc(), F.col("coluna")]).collect()
        assert [r.coluna for r in best] == [r.coluna for r in rows[:top]]


def test_preview_counts_consumers_on_the_exchange_of_the_marking(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ind.ci_chi_preview(catalog.marked_long(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    keyed = [ln for ln in plan.split("\n") if "Exchange hashpartitioning" in ln]
    # one by consumer, which the marking needs, and one of a row per band and region
    assert len(keyed) == 2 and sum("NUM_UC_UCI" in ln for ln in keyed) == 1


def test_a_date_alone_is_a_timestamp(spark):
    row = spark.createDataFrame([("2024-01-05",)], "t string").select(S.parse_ts("t").alias("v")).first()
    assert row.v == dt.datetime(2024, 1, 5)


def test_names_with_quotes_pass_the_quality_tests(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`it's` int, `a b` string")
    assert {r.coluna: r.nulos for r in dq.null_check(df).collect()} == {"it's": 0, "a b": 1}
