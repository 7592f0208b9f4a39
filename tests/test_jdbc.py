"""The relational reader is only built here (no database is reachable)."""

import pytest

from outagekit.sources import jdbc


def test_bind_month():
    sql = "SELECT 1 FROM t WHERE to_char(d, 'YYYYMM') = :data_mes"
    assert jdbc.bind_month(sql, "202401").endswith("= '202401'")
    with pytest.raises(ValueError):
        jdbc.bind_month(sql, "2024-01")


def test_reader_builds_without_connecting(spark):
    r = jdbc.reader(spark, "jdbc:example://host/db", "SELECT 1 AS x", user="u", password="p",
                    partition_column="x", lower=0, upper=100, num_partitions=8)
    assert r is not None  # options only; nothing is read until .load()
