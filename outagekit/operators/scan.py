"""Ordered scans per key that survive a hot key.

Running maxima, running counts, lag and lead per consumer are windows
partitioned by the key; a key that holds a large share of the rows would
put that share into one task.  For such keys the rows are range-partitioned
on (key, order), which cuts one key's sorted run into several ordered
chunks; the window runs per (key, chunk), and the values that cross a
chunk border are taken from a per-chunk summary:

* the previous chunk's last row (for lag), the next chunk's first row
  (for lead), the maximum and the sum over all earlier chunks (for running
  maxima and counts).

The summary has one row per (key, chunk) pair.  Chunks are contiguous
ranges of the sort order, so the pairs number at most (#hot keys +
#chunks); hot keys are keys above ``threshold`` rows, so there are at most
rows / threshold of them.  That bound is what allows broadcasting the
summary back to the rows; it is checked before the hint is placed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
DEFAULT_HOT_ROWS = 1_000_000
ROWS_PER_CHUNK = 2_000_000
#: Rows of a side that is broadcast without asking the planner.
MAX_BROADCAST = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows and their row counts (a
    map-side combined count).  At most rows / threshold keys qualify."""
    return (df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > threshold))


def join_keys(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null: a group of rows without a
    key is a group like any other."""
    names = [f"__k{i}" for i in range(len(keys))]
    side = small.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
                        *[F.col(f"`{c}`") for c in small.columns if c not in keys])
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return df.join(side, cond, how).drop(*names)


def split_hot(df: DataFrame, keys: Sequence[str], threshold: int,
              hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, int] | None:
    """(ordinary rows, hot-key rows, number of hot keys, of hot rows), or
    None when no key is hot.

    The hot keys and their counts are found once: one action brings at most
    ``MAX_BROADCAST`` + 1 of them to the driver, and both branches join that
    local table.  More hot keys than that stay distributed, and the planner
    chooses the joins.  A caller that knows its hot keys passes them as
    ``hot`` (the key columns and ``__n``)."""
    hk = hot_keys(df, keys, threshold) if hot is None else hot
    rows = hk.limit(MAX_BROADCAST + 1).collect()
    if not rows:
        return None
    if len(rows) <= MAX_BROADCAST:
        n_keys, n_rows = len(rows), sum(r["__n"] for r in rows)
        side = F.broadcast(df.sparkSession.createDataFrame(rows, hk.schema).drop("__n"))
    else:
        n_keys, n_rows = hk.agg(F.count(F.lit(1)), F.sum("__n")).first()
        side = hk.drop("__n")
    return join_keys(df, side, keys, "left_anti"), join_keys(df, side, keys, "left_semi"), n_keys, int(n_rows)


def chunk_count(spark, hot_rows: int | None) -> int:
    """Enough chunks for about ROWS_PER_CHUNK rows each, never fewer than
    the session's shuffle partitions."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not hot_rows:
        return base
    return max(base, -(-hot_rows // ROWS_PER_CHUNK))


def chunked(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], n_chunks: int | None = None) -> DataFrame:
    """Range-partition on (keys, order), tag each row with its chunk, and
    cluster by (keys, chunk).

    Range bounds come from a sample taken when the exchange runs, so two
    executions may cut different chunks.  The tagged rows are therefore
    checkpointed (a reliable checkpoint in ``spark.checkpoint.dir``): every
    later branch reads the same chunks, a lost executor re-reads them
    instead of re-sampling, and the clustering by (keys, chunk) is kept, so
    the windows and per-chunk summaries that follow need no exchange."""
    from outagekit.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)  # raises before any work where there is none
    n = n_chunks or chunk_count(spark, None)
    tagged = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return tagged.repartition(n, *keys, F.col(CHUNK)).checkpoint(eager=True)


def chunk_window(keys: Sequence[Column], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, F.col(CHUNK)).orderBy(*order)


def border_carry(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], last: Sequence[str] = (),
                 first: Sequence[str] = (), max_cols: Sequence[str] = (), sum_cols: Sequence[str] = (),
                 pairs: int | None = None) -> DataFrame:
    """Join to every row the values that cross chunk borders.

    Adds ``__has_prev``, ``__pl_<c>`` (previous chunk's last-row value),
    ``__nf_<c>`` (next chunk's first-row value), ``__pm_<c>`` (maximum over
    earlier chunks) and ``__ps_<c>`` (sum over earlier chunks, 0 if none).
    ``order_cols`` are the (ascending, nulls first) sort columns; struct
    comparison orders them the same way.  The per-chunk aggregate needs no
    exchange: rows are already clustered by (key, chunk).  ``pairs`` is the
    known bound of (key, chunk) pairs; up to MAX_BROADCAST of them are
    broadcast, else the planner chooses."""
    ordkey = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.lit(1).alias("__one")]
    aggs += [F.max_by(F.col(c), ordkey).alias(f"__L_{c}") for c in last]
    aggs += [F.min_by(F.col(c), ordkey).alias(f"__F_{c}") for c in first]
    aggs += [F.max(F.col(c)).alias(f"__M_{c}") for c in max_cols]
    aggs += [F.sum(F.col(c)).alias(f"__S_{c}") for c in sum_cols]
    kc = [F.col(f"`{k}`") for k in keys]
    summ = df.groupBy(*kc, CHUNK).agg(*aggs)
    ws = Window.partitionBy(*kc).orderBy(CHUNK)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*kc, F.col(CHUNK), F.lag("__one").over(ws).isNotNull().alias("__has_prev")]
    cols += [F.lag(f"__L_{c}").over(ws).alias(f"__pl_{c}") for c in last]
    cols += [F.lead(f"__F_{c}").over(ws).alias(f"__nf_{c}") for c in first]
    cols += [F.max(f"__M_{c}").over(before).alias(f"__pm_{c}") for c in max_cols]
    cols += [F.coalesce(F.sum(f"__S_{c}").over(before), F.lit(0)).alias(f"__ps_{c}") for c in sum_cols]
    carry = summ.select(*cols)
    if pairs is not None and pairs <= MAX_BROADCAST:
        carry = F.broadcast(carry)
    return join_keys(df, carry, [*keys, CHUNK], "left")


def is_first(w: Window) -> Column:
    return F.lag(F.lit(1)).over(w).isNull()


def is_last(w: Window) -> Column:
    return F.lead(F.lit(1)).over(w).isNull()
