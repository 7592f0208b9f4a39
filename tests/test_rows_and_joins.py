"""Hot join keys and whole rows by digest, against the plain operations."""

import pytest
from pyspark.sql import functions as F

from outagekit.functions import rows as R
from outagekit.operators import intervals as iv
from outagekit.operators import quality as dq
from outagekit.operators.joins import left_join_hot
from outagekit.plans import catalog
from outagekit.sources import extract as ex
from outagekit.sources.fixtures import table

SF = "/root/testdata/sf0.01"
by_digest = R.by_digest


def same(a, b):
    b = b.select(*a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def plain_shuffles(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_history(spark, n=20_000):
    """40 % of the rows on one key, a fifth without a key."""
    key = F.when(F.col("id") % 10 < 4, F.lit(7)).when(F.col("id") % 10 < 8, F.col("id")).cast("long")
    return spark.range(n).repartition(8).select(F.col("id").alias("row"), F.lit("L").alias("code"), key.alias("k"))


def details(spark, per_hot=1):
    some = spark.range(0, 20_000, 3).select(F.lit("L").alias("of_code"), F.col("id").alias("of_k"), F.lit(0).alias("nr"))
    hot = spark.range(per_hot).select(F.lit("L").alias("of_code"), F.lit(7).cast("long").alias("of_k"), F.col("id").cast("int").alias("nr"))
    gap = spark.range(1).select(F.lit("L").alias("of_code"), F.lit(None).cast("long").alias("of_k"), F.lit(9).alias("nr"))
    return some.where("of_k <> 7").unionByName(hot).unionByName(gap)


ON = [("code", "of_code"), ("k", "of_k")]


@pytest.mark.parametrize("per_hot,max_rows", [(1, 100), (3, 100), (3, 2)])
def test_hot_key_is_dealt_over_tasks(spark, plain_shuffles, per_hot, max_rows):
    left, right = hot_history(spark), details(spark, per_hot)
    plain = left.join(right, (F.col("code") == F.col("of_code")) & (F.col("k") == F.col("of_k")), "left")
    got = left_join_hot(left, right, ON, hot_rows=500, max_rows=max_rows)
    assert same(plain, got)

    def largest(df):
        sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
        return sizes.agg(F.max("count") / F.sum("count")).first()[0]

    assert largest(plain) > 0.4
    assert largest(got) < 0.2


def test_without_hot_keys_the_join_is_plain(spark):
    left, right = hot_history(spark), details(spark)
    plan = left_join_hot(left, right, ON, hot_rows=50_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in details(spark)._jdf.queryExecution().optimizedPlan().toString() and plan.count("Join") == 1
    empty = left.limit(0)
    assert left_join_hot(empty, right, ON, hot_rows=1).count() == 0
    assert left_join_hot(left, right.limit(0), ON, hot_rows=500).where("nr IS NULL").count() == 20_000


def test_sampled_keys(spark):
    """With a share below 1 the hot key is still found."""
    left, right = hot_history(spark, 60_000), details(spark)
    got = left_join_hot(left, right, ON, hot_rows=6_000)
    assert got.count() == 60_000 and got.where("k = 7 AND nr IS NULL").count() == 0


def test_extraction_with_hot_interruption(spark):
    hist, intrp = table(spark, SF, "hist_src"), table(spark, SF, "intrp_src")
    one = hist.where("num_intrp_hcai % 3 = 0").withColumns({
        "num_intrp_hcai": F.lit(8).cast("long"), "num_intrp_inic_manobra_hcai": F.lit(None).cast("long"),
        "indic_reg_orig_intrp_hcai": F.lit("C")})
    more = hist.unionByName(one)
    plain = ex.join_self_start_end(more, intrp, hot_rows=10**12)
    hot = ex.join_self_start_end(more, intrp, hot_rows=300)
    assert hot._jdf.queryExecution().optimizedPlan().toString().count("Join") > 2
    assert same(plain, hot)


def odd_rows(spark):
    rows = [(1, "a", None, 0.0), (1, None, "a", 0.0), (1, "a", None, -0.0), (1, "a", None, 0.0), (None, None, None, None),
            (None, None, None, None), (2, "", "", float("nan")), (2, "", "", float("nan")), (3, "x" * 100_000, "y", 1.0)]
    return spark.createDataFrame(rows, "i long, s string, t string, d double")


def first_column(df):
    return F.struct(F.xxhash64(df.columns[0]).alias("a"), F.lit(0).alias("b"))


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("limit", [0, R.MAX_DIGESTS])
def test_rows_by_digest_equal_plain(spark, clash, limit, monkeypatch):
    if clash:  # all rows with one first value have one digest
        monkeypatch.setattr(R, "by_digest", lambda df: by_digest(df, first_column, limit))
    else:
        monkeypatch.setattr(R, "by_digest", lambda df: by_digest(df, max_digests=limit))
    monkeypatch.setattr(dq, "by_digest", R.by_digest)
    monkeypatch.setattr(R, "is_wide", lambda df: True)
    monkeypatch.setattr(dq, "is_wide", lambda df: True)
    df = odd_rows(spark)
    assert same(df.dropDuplicates(), iv.dedup_exact(df))
    assert iv.dedup_exact(df).count() == 5
    assert tuple(dq.duplicate_check(df).first()) == (5, 4, 9)
    assert iv.dedup_exact(df.limit(0)).count() == 0
    li = catalog.copied_lineitem(spark, "/root/testdata/sf0.001")
    assert same(li.dropDuplicates(), iv.dedup_exact(li))


def test_single_rows_are_not_shuffled(spark):
    li = table(spark, SF, "lineitem")
    assert R.is_wide(li) and not R.is_wide(li.select("l_orderkey", "l_linenumber"))
    once, _ = R.by_digest(li)
    assert "Exchange hashpartitioning(l_" not in once._jdf.queryExecution().executedPlan().toString()
