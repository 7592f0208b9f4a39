"""Sources and sinks.

Writes never touch a path that is being read: rewrites go to a new
versioned folder and readers take the newest committed one, so a failed or
killed job leaves the previous version intact and a retried task simply
rewrites its own part files.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions.scalars import parse_year_month


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (with header) or Parquet by suffix; anything else is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        r = spark.read.option("header", True)
        return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", False).csv(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    fs, p = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def bronze_as_string(df: DataFrame) -> DataFrame:
    """Every column as text (S3), the raw layer of an extraction."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def _norm_path(p: str) -> str:
    """Normalise the path part only, so 'hdfs://' or 's3a://' keep their scheme."""
    if "://" in p:
        scheme, rest = p.split("://", 1)
        host, _, path = rest.partition("/")
        return f"{scheme}://{host}/{posixpath.normpath(path)}" if path else f"{scheme}://{host}"
    return posixpath.normpath(p)


def scan_processed(spark: SparkSession, paths: Sequence[str], recursive: bool = True) -> DataFrame:
    """Union of processed inputs, each path once, in sorted order.
    One scan over all paths with schema merging; no per-file loop."""
    uniq = sorted({_norm_path(p) for p in paths})
    return (spark.read.option("recursiveFileLookup", str(recursive).lower())
            .option("mergeSchema", "true").parquet(*uniq))


def extract_limit(df: DataFrame, limit_rows: int | None, order: Sequence[str] = ()) -> DataFrame:
    """Exact cap on extracted rows, none when ``limit_rows`` is falsy (S6);
    with ``order`` the rows are the first in that order, else any."""
    if not limit_rows:
        return df
    return (df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]) if order else df).limit(int(limit_rows))


def add_month_partition(df: DataFrame, month_col: str) -> DataFrame:
    """(ano, mes) partition columns, 'YYYY' and 'MM', from a timestamp or a
    free month text (P8)."""
    dt = df.schema[month_col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        year, month = F.year(month_col), F.month(month_col)
    else:
        ym = parse_year_month(month_col)
        year, month = ym["ano"], ym["mes"]
    return df.withColumns({"ano": F.lpad(year.cast("string"), 4, "0"), "mes": F.lpad(month.cast("string"), 2, "0")})


def write_month_partition(df: DataFrame, target: str, month_col: str) -> str:
    """Write Hive-style ``ano=YYYY/mes=MM`` partitions (K1).  Dynamic
    partition overwrite replaces only the months present in ``df``, so a
    rerun of one month leaves the others alone."""
    (add_month_partition(df, month_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ano", "mes").parquet(target))
    return target


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def overwrite_processed(df: DataFrame, base_dir: str) -> str:
    """Write a new version of a processed table next to the old ones (K2).

    Versions are folders named by write time; a version counts once its
    job has committed (Spark's ``_SUCCESS`` marker), so readers never see a
    half-written table and readers of an older version are not disturbed.
    Works on any Hadoop file system (HDFS, object stores, local)."""
    version = f"{base_dir.rstrip('/')}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(version)
    return version


def read_current(spark: SparkSession, base_dir: str) -> DataFrame:
    """The newest committed version under ``base_dir``."""
    fs, root = _fs(spark, base_dir)
    done = [st.getPath() for st in fs.listStatus(root)
            if st.isDirectory() and st.getPath().getName().startswith("v-")
            and fs.exists(st.getPath().suffix("/_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no committed version under {base_dir}")
    newest = max(done, key=lambda p: p.getName())
    return spark.read.parquet(newest.toString())


BILLED_SCHEMA = T.StructType([
    T.StructField("REGIONAL_TOTAL", T.StringType()),
    T.StructField("SIGLA_REGIONAL", T.StringType()),
    T.StructField("ANOMES", T.StringType()),
    T.StructField("UC_FATURADA", T.DoubleType()),
])


def write_billed_uc(df: DataFrame, target: str) -> str:
    """Billed-consumer sink with a declared schema (K3): an empty result
    still writes a typed (empty) table."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in BILLED_SCHEMA.fields]
    df.select(*cols).write.mode("overwrite").parquet(target)
    return target


#: Most rows of a result that is handed over as one file.
ONE_FILE_ROWS = 1_000_000


def export_results(df: DataFrame, target: str, fmt: str = "csv") -> str:
    """Result tables to CSV (header) or Parquet (K4).  A CSV result of at most
    ``ONE_FILE_ROWS`` rows goes out as one part file for hand-off; the rows
    are brought together by an exchange, so what computes them keeps its
    tasks.  Larger results keep their partitions."""
    if fmt == "csv":
        if df.limit(ONE_FILE_ROWS + 1).count() <= ONE_FILE_ROWS:
            df = df.repartition(1)
        df.write.mode("overwrite").option("header", True).csv(target)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(target)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return target


#: Column of a read with ``load_csv_tagged`` that holds the text of a bad record.
BAD_RECORD = "__registro_ruim"
#: Column of such a read with the file of a record.
RECORD_FILE = "__arquivo"


def load_csv_tagged(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, header: bool = True,
                    line_breaks: bool = False, sep: str = ",") -> DataFrame:
    """CSV records with their file in ``RECORD_FILE`` and, for a bad one, its
    text in ``BAD_RECORD``.

    A record is bad if it has more or fewer fields than the schema or a field
    that is not of its type; without a schema all columns are text, named by
    the header of the first file.  With ``line_breaks`` a quoted field may
    hold line ends; a file is then read by one task, and a quote that is never
    closed makes one bad record of what follows it in its file.  Files without
    records give none."""
    paths = [path] if isinstance(path, str) else list(path)
    r = spark.read.option("header", header).option("sep", sep).option("multiLine", line_breaks).option("escape", '"')
    if schema is None:
        if not header:
            raise ValueError("records without a header need a schema")
        schema = r.csv(paths).schema
    tagged = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    rows = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).schema(tagged).csv(paths)
    # all fields are parsed whatever a query needs (columns are not pruned through a generator),
    # or a record would be good in one query and bad in another
    every = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(F.inline(F.array(F.struct(*every, F.col("_metadata.file_path").alias(RECORD_FILE)))))


def good_records(tagged: DataFrame) -> DataFrame:
    """The records that fit the schema."""
    return tagged.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD, RECORD_FILE)


def reject_report(tagged: DataFrame) -> DataFrame:
    """Per file its good and bad records and the first bad one in text order:
    arquivo, lidos, rejeitados, exemplo.  One aggregate over one scan, combined
    before the shuffle.  Files without records are not listed."""
    bad = F.col(BAD_RECORD)
    return tagged.groupBy(F.col(RECORD_FILE).alias("arquivo")).agg(
        F.count_if(bad.isNull()).alias("lidos"), F.count_if(bad.isNotNull()).alias("rejeitados"), F.min(bad).alias("exemplo"))
