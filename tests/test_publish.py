"""Atomic publishing: races, readers between commits, killed writers, clean-up."""

import datetime as dt
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from outagekit.sources import publish as pub


def months(spark, **per_month):
    """``m01=3`` gives three rows of January."""
    rows = [(int(m[1:]), dt.datetime(2024, int(m[1:]), 1 + i)) for m, n in per_month.items() for i in range(n)]
    return spark.createDataFrame(rows, "m int, t timestamp_ntz")


def counts(spark, base, commit=None):
    return {r.mes: r["count"] for r in pub.read_published(spark, base, commit).groupBy("mes").count().collect()}


def test_put_if_absent_has_one_winner(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: pub.put_if_absent(spark, path, str(i)), range(64)))
    assert sum(won) == 1
    assert int(open(path).read()) == won.index(True)
    assert os.listdir(tmp_path / "log") == ["1.json"]


def test_months_are_replaced_and_history_stays(spark, tmp_path):
    base = str(tmp_path / "t")
    first = pub.publish_months(months(spark, m01=3, m02=2), base, "t")
    pub.publish_months(months(spark, m02=5, m03=1), base, "t")
    assert counts(spark, base) == {"01": 3, "02": 5, "03": 1}
    assert counts(spark, base, first) == {"01": 3, "02": 2}
    pub.publish_months(months(spark, m03=4), base, "t", months=["2024-01"])
    assert counts(spark, base) == {"02": 5, "03": 4}
    pub.publish_table(months(spark, m12=1), base, "t")
    assert counts(spark, base) == {"12": 1}
    assert pub.current(spark, base).number == 4


def test_writers_of_one_month_have_one_winner(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    pub.publish_months(months(spark, m01=1, m02=1), base, "t")
    began = pub.current(spark, base)

    def publish(n):
        try:
            pub.publish_months(months(spark, m01=n), base, "t")
            return n
        except pub.PublishConflict:
            return None

    # every writer sees the table as it was before any of them was done
    real, stale = pub.current, {}

    def at_start(s, b):
        me = threading.get_ident()
        if me not in stale:
            stale[me] = True
            return began
        return real(s, b)

    monkeypatch.setattr(pub, "current", at_start)
    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(publish, [10, 11, 12, 13]) if n]
    monkeypatch.setattr(pub, "current", real)
    # a thread of the pool may take a second writer, which then sees the winner and follows it
    assert won and counts(spark, base)["01"] in won
    assert pub.current(spark, base).number == began.number + len(won)
    assert counts(spark, base)["02"] == 1


def test_conflict_and_disjoint_months(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    pub.publish_months(months(spark, m01=1, m02=1), base, "t")
    before = pub.current(spark, base)
    real = pub.current
    pub.publish_months(months(spark, m01=2), base, "t")

    def began_before():
        seen = iter([before])
        monkeypatch.setattr(pub, "current", lambda s, b: next(seen, None) or real(s, b))

    began_before()
    with pytest.raises(pub.PublishConflict):
        pub.publish_months(months(spark, m01=7), base, "t")
    began_before()
    with pytest.raises(pub.PublishConflict):
        pub.publish_table(months(spark, m05=7), base, "t")
    began_before()
    pub.publish_months(months(spark, m02=9), base, "t")
    assert counts(spark, base) == {"01": 2, "02": 9}


def test_reader_never_sees_an_unfinished_publish(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    pub.publish_months(months(spark, m01=3), base, "t")
    reader = pub.read_published(spark, base)

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(pub, "put_if_absent", killed)
    with pytest.raises(KeyboardInterrupt):
        pub.publish_months(months(spark, m01=8, m02=8), base, "t")
    monkeypatch.undo()
    assert counts(spark, base) == {"01": 3}
    # a commit file that its writer did not finish counts for nothing, and stops the next writer
    broken = pub._log_path(base, 2)
    open(broken, "w").write('{"schema": ')
    assert counts(spark, base) == {"01": 3}
    with pytest.raises(pub.PublishConflict):
        pub.publish_months(months(spark, m01=5), base, "t")
    assert len(pub.clean(spark, base, older_than_s=0)) == 2  # what the killed and the refused writer left
    assert not os.path.exists(broken)
    pub.publish_months(months(spark, m01=5), base, "t")
    assert counts(spark, base) == {"01": 5}
    assert reader.count() == 3  # the folders of the last two commits stay


def test_clean_keeps_what_commits_name(spark, tmp_path):
    base = str(tmp_path / "t")
    pub.publish_months(months(spark, m01=1, m02=2), base, "t")
    for n in (3, 4, 5):
        pub.publish_months(months(spark, m01=n), base, "t")
    assert pub.clean(spark, base) == []  # all too young
    assert len(pub.clean(spark, base, keep=1, older_than_s=0)) == 2  # m01=3 and m01=4; the first still holds February
    assert counts(spark, base) == {"01": 5, "02": 2}


def test_empty_null_months_and_other_columns(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        pub.read_published(spark, base)
    pub.publish_table(months(spark), base, "t")
    assert pub.read_published(spark, base).columns == ["m", "t", "ano", "mes"]
    assert pub.read_published(spark, base).count() == 0
    gap = months(spark, m01=1).unionByName(months(spark, m02=1).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    pub.publish_months(gap, base, "t")
    assert counts(spark, base) == {"01": 1, None: 1}
    pub.publish_months(months(spark, m01=2), base, "t")
    assert counts(spark, base) == {"01": 2, None: 1}
    with pytest.raises(ValueError):
        pub.publish_months(months(spark, m01=2).withColumn("x", F.lit(1)), base, "t")


def test_month_filter_reads_one_folder(spark, tmp_path):
    base = str(tmp_path / "t")
    pub.publish_months(months(spark, m01=3, m02=2, m11=4), base, "t")
    one = pub.read_published(spark, base).where(pub.month_filter("2024-11"))
    assert [r.m for r in one.collect()] == [11] * 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = next(ln for ln in plan.split("\n") if "FileScan" in ln)
    assert "mes" in scan.split("PartitionFilters: [")[1].split("]")[0]
