"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    A cluster's session without one is an error; in local mode, where all
    tasks share the driver's process, a scratch folder is set."""
    return checkpoint_dir(spark)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a checkpoint's file where the number of rows is known.
CUT_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.  With
    ``rows``, about how many there are, it has no more files than they need."""
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // CUT_ROWS)))
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on text that is all
    ASCII (and is many times faster than ``translate``)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(df: DataFrame) -> DataFrame:
    """``df`` with the locator of each row: ``__file`` and ``__row`` of the
    Parquet files it is read from.  A frame that is not such a read is
    written to the shared folder first, so the locator always names one
    stored row - repeated rows included - and survives lost executors."""
    try:
        out = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        out.schema  # resolves the hidden column now, not later
        return out
    except AnalysisException:
        path = fresh_dir(df.sparkSession, "located")
        df.write.parquet(path)
        return located(df.sparkSession.read.schema(df.schema).parquet(path))


def located_rows(df: DataFrame) -> DataFrame:
    """``located`` with the whole row in one struct, ``__doc``: whatever
    its columns are called, they clash with none of the operator's."""
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc")
    try:
        out = df.select(packed, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        out.schema
        return out
    except AnalysisException:
        path = fresh_dir(df.sparkSession, "located")
        df.select(packed).write.parquet(path)
        return located(df.sparkSession.read.parquet(path))


def barrier(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """``df`` with ``cols`` added, each computed once per row: the values
    pass through a generator, which the optimizer does not inline, so a
    lambda that reads them does not compute them again for each element."""
    s = F.struct(*[F.col(k) for k in keep], *[c.alias(n) for n, c in cols.items()])
    return df.select(F.inline(F.array(s)))
