"""One consumer's overlap walk over many chunks equals the plain walk."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from outagekit.operators import intervals as iv
from outagekit.operators import scan as SC
from outagekit.operators import walk as WK

from test_brute_force import BASE, walk

SCHEMA = ("NUM_UC_UCI string, NUM_INTRP_UCI string, DTHR_INICIO_INTRP_UC timestamp_ntz, "
          "DATA_HORA_FIM_INTRP timestamp_ntz")


def rows_of(kind: str, n: int = 900) -> list[tuple]:
    r = random.Random(kind)
    at = lambda s: BASE + dt.timedelta(seconds=s)
    if kind == "one cover":  # one champion outlasts every chunk
        rows = [(0, 100_000)] + [(10 * i, 10 * i + 40) for i in range(1, n)]
    elif kind == "ever longer":  # each row replaces the one before, through all chunks
        rows = [(i, 3 * i + 2) for i in range(n)]
    elif kind == "ever shorter":  # all lose against the first until it ends
        rows = [(i, i + 2 * n - i) for i in range(n)]
    elif kind == "two chains":  # which rows stay depends on how the walk began
        rows = [(0, 15)] + [(10 * i, 10 * i + 15) for i in range(1, n)]
    elif kind == "points":
        rows = [(i // 3, i // 3 + (i % 3)) for i in range(n)]
    else:
        rows = [(s := r.randrange(4 * n), s + r.choice([0, 1, 5, 30, 200, r.randrange(1, 2 * n)])) for _ in range(n)]
    return [(None if kind == "no key" else "A", f"{i:05d}", at(s), at(e)) for i, (s, e) in enumerate(rows)]


@pytest.mark.parametrize("kind", ["one cover", "ever longer", "ever shorter", "two chains", "points", "random", "no key"])
def test_long_island_in_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(SC, "chunk_count", lambda spark, rows: 24)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df, skew="on").collect())
    assert got == walk([("A", *r[1:]) for r in rows])


def test_chunks_of_many_consumers_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(SC, "chunk_count", lambda spark, rows: 16)
    rows = [(f"{kind[:5]}", f"{kind}{r[1]}", *r[2:]) for kind in ("one cover", "two chains", "random", "ever longer") for r in rows_of(kind, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df, skew="on").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == walk(rows)


def test_a_champion_that_outlasts_chunks_is_passed_on_unseen(spark, monkeypatch):
    """However many chunks it covers, it takes no further walk."""
    monkeypatch.setattr(SC, "chunk_count", lambda spark, rows: 24)
    rounds, plain = [], WK.settle
    monkeypatch.setattr(WK, "settle", lambda chunks: rounds.append(1) or plain(chunks))
    iv.resolve_overlaps(spark.createDataFrame(rows_of("one cover"), SCHEMA), skew="on").collect()
    assert len(rounds) <= 2


def test_every_chunk_has_its_share(spark):
    """One island of 60,000 rows: no task walks much more than its chunk."""
    df = spark.range(60_000).select(
        F.lit("A").alias("NUM_UC_UCI"), F.col("id").cast("string").alias("NUM_INTRP_UCI"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("DTHR_INICIO_INTRP_UC"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id + 2 + (id * 7919) % 13)").alias("DATA_HORA_FIM_INTRP"))
    hot = iv.tag_overlaps(df, "NUM_UC_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", hot_rows=1000)
    per_task = [r.n for r in hot.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 60_000 and len(per_task) >= 4 and max(per_task) < 30_000
    one = iv.tag_overlaps(df, "NUM_UC_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", skew="off")
    kept = lambda x: sorted(r[0] for r in x.where("__keep").select("NUM_INTRP_UCI").collect())
    assert kept(hot) == kept(one)
