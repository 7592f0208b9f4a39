"""Whole rows told apart by a digest first.

To find equal rows, every row has to meet its equals; with all columns as the
key, all of the table is shuffled.  Here 128-bit digests are counted, and only
rows whose digest repeats are shuffled and compared column by column, so two
unlike rows with one digest stay two rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagekit.operators.joins import broadcast_bounded

#: Rows of digests that are broadcast: 16 bytes each.
MAX_DIGESTS = 1_000_000


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row; equal rows (null equal to null) have equal
    digests.  Which columns are null is part of it."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols]) if cols else F.lit("")
    return F.struct(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(*cols, nulls, F.lit("b")).alias("b"))


def is_wide(df: DataFrame) -> bool:
    """Whether a row is several times as wide as its digest (by its schema)."""
    return df._jdf.schema().defaultSize() > 64


def by_digest(df: DataFrame, digest: Callable[[DataFrame], Column] = row_digest,
              max_digests: int = MAX_DIGESTS) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest occurs once, rows whose digest occurs more often).
    Digests are counted first, so a row leaves its task as 16 bytes, and whole
    rows go on only from the second frame.  With more than ``max_digests``
    repeated digests the planner chooses how rows meet them."""
    with_digest = df.select("*", digest(df).alias("__digest"))
    repeated = (with_digest.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
                .select(F.col("__digest").alias("__of")))
    side = broadcast_bounded(repeated, max_digests)
    same = F.col("__digest") == F.col("__of")
    return (with_digest.join(side, same, "left_anti").drop("__digest"),
            with_digest.join(side, same, "left_semi").drop("__digest"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeated rows."""
    if not is_wide(df):
        return df.dropDuplicates()
    once, again = by_digest(df)
    return once.unionByName(again.dropDuplicates())
