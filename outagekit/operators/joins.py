"""Join helpers.

A broadcast is only requested for a side whose size has been checked: the
side is counted (stopping one row past the bound) before the hint is
placed.  Beyond the bound the join is left to the planner, where AQE picks
the strategy from run-time sizes and splits skewed partitions.

``left_join_hot`` is a left join whose hot keys never meet in one task: the
left rows of a hot key stay where they are (or are dealt over tasks) and the
right rows of that key go to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagekit.operators.scan import DEFAULT_HOT_ROWS, MAX_BROADCAST, join_keys

DEFAULT_MAX_ROWS = 100_000


def broadcast_bounded(small: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """``F.broadcast(small)`` when it has at most ``max_rows`` rows, else
    ``small`` unchanged."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


#: Rows of a key that is just hot in the sample that hot keys are found in.
SAMPLE_HITS = 64


def _matches(pairs: Sequence[tuple[str, str]]):
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & (F.col(f"`{a}`") == F.col(f"`{b}`"))
    return cond


def _sampled_hot_keys(left: DataFrame, keys: Sequence[str], hot_rows: int) -> list:
    """The keys of about ``hot_rows`` rows and more, most frequent first.  They
    are looked for in a sample of the key columns, since most keys have few
    rows and an exact count would shuffle nearly all of them; the sample only
    decides how a key is joined, not with what."""
    share = min(1.0, SAMPLE_HITS / hot_rows)
    rows = left.select(*[f"`{k}`" for k in keys])
    rows = rows if share == 1.0 else rows.sample(share, seed=1)
    return (rows.groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > int(share * hot_rows)).orderBy(F.desc("__n")).limit(MAX_BROADCAST).collect())


def left_join_hot(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], hot_rows: int = DEFAULT_HOT_ROWS,
                  max_rows: int = MAX_BROADCAST, counted: DataFrame | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on pairs of (left, right) key columns; all
    columns of both sides, whose names must differ.

    Without hot keys this is the plain join.  Else the left rows of hot keys
    are split off.  If the right rows of those keys number at most ``max_rows``
    they are broadcast, so the hot left rows are not shuffled at all; beyond
    that each hot left row draws a salt from a hash of its columns and the
    right rows of hot keys are repeated for every salt.  A hot null key matches
    nothing and just goes with the hot rows.  At most ``MAX_BROADCAST`` keys,
    the most frequent, are treated as hot; the others are joined like any key.
    ``counted`` may name a cheaper frame with the same keys to look for hot ones
    in, such as ``left`` before an earlier join."""
    spark, keys = left.sparkSession, [a for a, _ in on]
    hot = _sampled_hot_keys(left if counted is None else counted, keys, hot_rows)
    if not hot:
        return left.join(right, _matches(on), "left")
    names = [f"__h{i}" for i in range(len(on))]
    schema = left.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).schema
    side = spark.createDataFrame([tuple(r)[:-1] for r in hot], schema)
    of_left = F.broadcast(side.toDF(*keys))
    cold_rows, hot_left = join_keys(left, of_left, keys, "left_anti"), join_keys(left, of_left, keys, "left_semi")
    hot_right = right.join(F.broadcast(side), _matches([(b, n) for (_, b), n in zip(on, names)]), "left_semi")
    if hot_right.limit(max_rows + 1).count() <= max_rows:
        joined = hot_left.join(F.broadcast(hot_right), _matches(on), "left")
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = hot_left.withColumn("__salt", F.pmod(F.xxhash64(*[f"`{c}`" for c in left.columns]), F.lit(salts)))
        copies = hot_right.withColumn("__of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = dealt.join(copies, _matches([*on, ("__salt", "__of_salt")]), "left").drop("__salt", "__of_salt")
    return cold_rows.join(right, _matches(on), "left").unionByName(joined)
