"""Order-dependent operators against a plain Python walk on random input."""

import datetime as dt
import random

from outagekit.operators import intervals as iv

BASE = dt.datetime(2024, 1, 1)


def walk(rows):
    """The importer's greedy walk, written from its description: intervals
    in start order; a strictly overlapping pair keeps the longer, the kept
    one on ties."""
    kept_all = []
    by_uc = {}
    for r in rows:
        by_uc.setdefault(r[0], []).append(r)
    for uc, group in by_uc.items():
        group.sort(key=lambda r: (r[2], r[3], r[1]))
        kept = []
        for cur in group:
            keep = True
            for prev in list(kept):
                if cur[2] < prev[3] and cur[3] > prev[2]:
                    if (cur[3] - cur[2]) <= (prev[3] - prev[2]):
                        keep = False
                        break
                    kept.remove(prev)
            if keep:
                kept.append(cur)
        kept_all += [r[1] for r in kept]
    return sorted(kept_all)


def test_resolve_overlaps_matches_walk(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        uc = str(rng.randrange(40))
        s = BASE + dt.timedelta(minutes=rng.randrange(0, 20000))
        e = s + dt.timedelta(minutes=rng.choice([0, 1, 5, 30, 90, 400, 1500]))
        rows.append((uc, f"{i:05d}", s, e))
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    got = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df).collect())
    assert got == walk(rows)


def test_resolve_overlaps_leaves_no_strict_overlap(spark):
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        s = BASE + dt.timedelta(seconds=rng.randrange(0, 10 ** 6))
        rows.append((str(rng.randrange(15)), f"{i:05d}", s, s + dt.timedelta(seconds=rng.randrange(0, 50000))))
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    out = iv.resolve_overlaps(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.NUM_UC_UCI, []).append((r.DTHR_INICIO_INTRP_UC, r.DATA_HORA_FIM_INTRP))
    for ivs in by.values():
        ivs.sort()
        for a, b in zip(ivs, ivs[1:]):
            assert not (b[0] < a[1] and b[1] > a[0])


def test_mark_overlaps_perceived_bounds_contain_members(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s = BASE + dt.timedelta(seconds=rng.randrange(0, 20000))
        rows.append((str(rng.randrange(5)), f"{i:05d}", s, s + dt.timedelta(seconds=rng.randrange(0, 90))))
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    out = iv.mark_overlaps(df).collect()
    merged = 0
    for r in out:
        assert r.verificado
        assert r.DTHR_INICIO_INTRP_PERCEBIDO <= r.DTHR_INICIO_INTRP_UC
        assert r.DATA_HORA_FIM_INTR_PERCEBIDO >= r.DATA_HORA_FIM_INTRP
        merged += r.NUM_INTRP_PERCEBIDA != r.NUM_INTRP_UCI
    assert merged > 0


def test_big_island_walk_matches(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        uc = str(rng.randrange(6))
        s = BASE + dt.timedelta(minutes=rng.randrange(0, 3000))
        e = s + dt.timedelta(minutes=rng.choice([0, 3, 30, 240, 900]))
        rows.append((uc, f"{i:05d}", s, e))
    # one very long interval per consumer makes most rows one big island
    for uc in range(6):
        rows.append((str(uc), f"L{uc}", BASE, BASE + dt.timedelta(minutes=1000)))
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    want = walk(rows)
    for skew in ("off", "on"):
        got = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df, skew=skew).collect())
        assert got == want, skew


def test_walk_state_crosses_arrow_batches(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        uc = str(rng.randrange(4))
        s = BASE + dt.timedelta(minutes=rng.randrange(0, 4000))
        rows.append((uc, f"{i:05d}", s, s + dt.timedelta(minutes=rng.choice([0, 2, 20, 200, 700]))))
    df = spark.createDataFrame(rows, "NUM_UC_UCI string, NUM_INTRP_UCI string, "
                                     "DTHR_INICIO_INTRP_UC timestamp_ntz, DATA_HORA_FIM_INTRP timestamp_ntz")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r.NUM_INTRP_UCI for r in iv.resolve_overlaps(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == walk(rows)
