"""Sinks round-trip in a scratch folder; plan-shape guards."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from outagekit.operators import indicators as ind
from outagekit.operators import intervals as iv
from outagekit.sources import io as sio
from outagekit.sources.fixtures import table

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_partition_rerun_replaces_only_that_month(spark):
    d = tempfile.mkdtemp(prefix="ok-k1-", dir="/tmp")
    b1 = table(spark, SF, "intr_long")
    sio.write_month_partition(b1, d, "DTHR_INICIO_INTRP_UC")
    before = spark.read.parquet(d).groupBy("ano", "mes").count().collect()
    jan = b1.where(F.month("DTHR_INICIO_INTRP_UC") == 1).limit(5)
    sio.write_month_partition(jan, d, "DTHR_INICIO_INTRP_UC")
    after = {(r.ano, r.mes): r["count"] for r in spark.read.parquet(d).groupBy("ano", "mes").count().collect()}
    assert after[(2024, 1)] == 5
    for r in before:
        if (r.ano, r.mes) != (2024, 1):
            assert after[(r.ano, r.mes)] == r["count"]


def test_month_partition_from_text(spark):
    d = tempfile.mkdtemp(prefix="ok-k1t-", dir="/tmp")
    df = spark.createDataFrame([("2024/3", 1), ("03-2024", 2), ("202404", 3)], "m string, v int")
    sio.write_month_partition(df, d, "m")
    got = sorted((r.ano, r.mes, r.v) for r in spark.read.parquet(d).collect())
    assert got == [(2024, 3, 1), (2024, 3, 2), (2024, 4, 3)]


def test_billed_sink_writes_typed_empty_table(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ok-k3-", dir="/tmp"), "uc")
    empty = spark.createDataFrame([], "REGIONAL_TOTAL string, SIGLA_REGIONAL string, ANOMES string, UC_FATURADA long")
    sio.write_billed_uc(empty, d)
    back = spark.read.parquet(d)
    assert back.count() == 0 and dict(back.dtypes)["UC_FATURADA"] == "double"


def test_versioned_overwrite_keeps_old_version(spark):
    base = tempfile.mkdtemp(prefix="ok-k2-", dir="/tmp")
    v1 = sio.overwrite_processed(spark.range(3), base)
    v2 = sio.overwrite_processed(spark.range(5), base)
    assert v1 != v2 and spark.read.parquet(v1).count() == 3
    assert sio.read_current(spark, base).count() == 5


def test_load_table_by_suffix(spark):
    d = tempfile.mkdtemp(prefix="ok-s1-", dir="/tmp")
    sio.export_results(spark.range(4).withColumn("x", F.col("id") * 2), os.path.join(d, "r.csv"), "csv")
    assert sio.load_table(spark, os.path.join(d, "r.csv")).count() == 4
    assert sio.load_table(spark, f"{SF}/region.parquet").count() == 5
    with pytest.raises(ValueError):
        sio.load_table(spark, "/tmp/x.xlsx")


def test_mark_overlaps_single_exchange(spark):
    p = _plan(iv.mark_overlaps(table(spark, SF, "intr_long")))
    assert p.count("Exchange hashpartitioning") == 1


def test_import_chain_single_exchange_for_overlaps(spark):
    df = iv.resolve_overlaps(table(spark, SF, "intr_long"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # rows alone in their island and the others share one exchange
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") == 1
    assert "Generate" not in final  # no regrouping / explode of islands


def test_month_filter_reaches_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    d = tempfile.mkdtemp(prefix="ok-pd-", dir="/tmp")
    iv.mark_overlaps(table(spark, SF, "intr_long")).write.mode("overwrite").parquet(d)
    marked = spark.read.parquet(d)
    billed = ind.load_billed_uc(table(spark, SF, "billed_month"))
    e = ind.eligible_rows(marked, "2024-03", billed.where(F.col("ANOMES") == "2024-03"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.split("\n") if "FileScan" in ln and "ok-pd-" in ln][0]
    pushed = scan.split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(DTHR_INICIO_INTRP_PERCEBIDO,2024-03-01T00:00)" in pushed
    assert "LessThan(DTHR_INICIO_INTRP_PERCEBIDO,2024-04-01T00:00)" in pushed
    assert "ReadSchema: struct<NUM_UC_UCI" in scan and "NUM_INTRP_UCI" not in scan.split("ReadSchema")[1]
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_consolidation_reuses_consumer_partitioning(spark):
    from outagekit.plans import catalog
    p = _plan(catalog.unique_long(spark, SF))
    # the window exchange on the consumer also serves the per-interruption
    # aggregate: no exchange keyed by (region, consumer, id)
    assert p.count("Exchange hashpartitioning(NUM_UC_UCI") == 1
    assert "Exchange hashpartitioning(REGIONAL_TOTAL" not in p


def test_month_filter_prunes_earlier_partitions(spark):
    d = tempfile.mkdtemp(prefix="ok-pp-", dir="/tmp")
    sio.write_month_partition(iv.mark_overlaps(table(spark, SF, "intr_long")), d, "DTHR_INICIO_INTRP_UC")
    marked = spark.read.parquet(d)
    billed = ind.load_billed_uc(table(spark, SF, "billed_month"))
    e = ind.eligible_rows(marked, "2024-03", billed.where(F.col("ANOMES") == "2024-03"), partition=("ano", "mes"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.split("\n") if "FileScan" in ln and "ok-pp-" in ln][0]
    assert "PartitionFilters: [" in scan and "mes" in scan.split("PartitionFilters: [")[1].split("]")[0]
    full = ind.eligible_rows(marked.drop("ano", "mes"), "2024-03", billed.where(F.col("ANOMES") == "2024-03"))
    assert e.count() == full.count() > 0
