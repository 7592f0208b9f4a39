"""Many Parquet files with unlike layouts (S4, and the per-file tests).

The layout of every file is read from its footer inside tasks - one job over
the list of files, however many there are.  A layout is told by its Parquet
schema; Spark then infers the column types of one file per layout, so the
number of jobs is one plus the number of layouts.  Files of one layout are
read by one scan.

A footer is opened by the storage library of the workers (local paths, HDFS,
the common object stores).  Where a path's scheme is not one of them, Spark
reads that file's schema from the driver instead.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions import scalars as S
from outagekit.functions.schema import is_numeric
from outagekit.sources.io import _fs, _norm_path

#: Files per task of the footer job.
FILES_PER_TASK = 50
#: What a null partition value is written as.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Layout:
    """Files (or folders of files) with one schema."""

    schema: T.StructType
    paths: list[str] = field(default_factory=list)


def _bare(name: str) -> bool:
    return name.startswith(("_", "."))


def data_files(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """The Parquet files of a path: itself, or those of a folder (and of the
    folders in it), but for hidden ones."""
    fs, p = _fs(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    out, open_ = [], [p]
    while open_:
        for st in fs.listStatus(open_.pop()):
            name = st.getPath().getName()
            if st.isDirectory():
                if recursive and not _bare(name):
                    open_.append(st.getPath())
            elif name.endswith(".parquet") and not _bare(name):
                out.append(st.getPath().toString())
    return sorted(out)


def _footers():
    """(path, files) to the layouts of the files, or what is wrong."""

    def footers(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kinds, wrong = set(), None
                try:
                    for f in files:
                        try:
                            fs, at = pa.fs.FileSystem.from_uri(f if "://" in f or f.startswith("/") else f.replace("file:", "file://", 1))
                        except Exception:  # a scheme that these workers cannot open
                            kinds = None
                            break
                        with fs.open_input_file(at) as source:
                            kinds.add(str(pq.ParquetFile(source).schema).split("\n", 1)[1])  # its first line names the object
                except Exception as e:
                    wrong = f"{type(e).__name__}: {e}".split("\n")[0]
                rows.append((path, None if kinds is None or wrong else "\n".join(sorted(kinds)), wrong))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["p", "k", "w"])

    return footers


def layouts(spark: SparkSession, paths: Sequence[str]) -> tuple[list[Layout], list[tuple[str, str]]]:
    """The layouts among ``paths`` (files or folders, each as a whole), and
    (path, message) of those that cannot be read."""
    listed, failed = [], []
    for path in paths:
        try:
            files = data_files(spark, path)
            if not files:
                raise FileNotFoundError(f"no Parquet file in {path}")
            listed.append((path, files))
        except Exception as e:  # an unreadable input is a result here, not a failure of the others
            failed.append((path, str(e).split("\n")[0]))
    if not listed:
        return [], failed
    tasks = -(-sum(len(f) for _, f in listed) // FILES_PER_TASK)
    rows = spark.createDataFrame(listed, "p string, f array<string>").repartition(max(1, tasks))
    seen = {r.p: r for r in rows.mapInArrow(_footers(), "p string, k string, w string").collect()}
    found: dict[str, Layout] = {}
    for path, _ in listed:
        kind, wrong = seen[path].k, seen[path].w
        if wrong is None and kind not in found:
            try:
                schema = spark.read.parquet(path).schema
                kind = kind or f"inferred {schema.json()}"
                found.setdefault(kind, Layout(schema))
            except Exception as e:
                wrong = str(e).split("\n")[0]
        if wrong is None:
            found[kind].paths.append(path)
        else:
            failed.append((path, wrong))
    return list(found.values()), failed


def input_of_row() -> Column:
    """The input a row comes from: its file, or the folder ``*.parquet`` that
    the file is in."""
    return F.regexp_replace(F.col("_metadata.file_path"), r"^(.*\.parquet)/[^/]+$", "$1")


def bare_path(path: Column) -> Column:
    """A path without scheme and host (Spark writes paths with them)."""
    return F.regexp_replace(path, r"^[a-z0-9+.]+:(//[^/]*(?=/))?", "")


def agreed_type(types: Sequence[T.DataType]) -> T.DataType:
    """One type for a column that files hold in several.

    Whole numbers go to the widest, with decimals to a decimal that holds
    both, with floating ones to double; a date beside a timestamp is a
    timestamp; text beside a typed column takes the type (a raw export beside
    its processed table).  What has no common type is text."""
    kinds = sorted({t.json(): t for t in types if not isinstance(t, T.NullType)}.values(), key=lambda t: t.json())
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return kinds[0]
    typed = [t for t in kinds if not isinstance(t, T.StringType)]
    if len(typed) < len(kinds):
        return agreed_type(typed)
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if all(type(t) in whole for t in kinds):
        return max(kinds, key=lambda t: whole.index(type(t)))
    if all(is_numeric(t) for t in kinds):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in kinds):
            return T.DoubleType()
        scale = max(getattr(t, "scale", 0) for t in kinds)
        digits = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in kinds)
        return T.DecimalType(min(38, digits + scale), scale)
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in kinds):
        return T.TimestampNTZType()
    return T.StringType()


def as_type(name: str, have: T.DataType, want: T.DataType) -> Column:
    """A column in the agreed type; text that is no such value is null."""
    c = F.col(f"`{name}`")
    if have == want:
        return c
    if isinstance(have, T.StringType):
        if isinstance(want, (T.TimestampType, T.TimestampNTZType)):
            return S.parse_ts(name, have).cast(want)
        return c.try_cast(want)
    return c.cast(want)


def _partition_names(root: str, files: Sequence[str]) -> list[str]:
    """Names of the ``name=value`` folders between a root and its files."""
    def local(p: str) -> str:
        return re.sub(r"^[a-z0-9+.]+:(//[^/]*(?=/))?", "", p)

    below = [local(f)[len(local(root)):].split("/")[:-1] for f in files]
    return list(dict.fromkeys(part.split("=", 1)[0] for folders in below for part in folders if "=" in part))


def _partition_value(name: str) -> Column:
    """The value of a ``name=value`` folder of the row's file, as text."""
    text = F.regexp_extract(F.col("_metadata.file_path"), f".*/{name}=([^/]*)/", 1)
    value = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when((text != "") & (text != NULL_PARTITION), value)


def scan_layouts(spark: SparkSession, paths: Sequence[str], recursive: bool = True) -> DataFrame:
    """Union of processed and raw inputs whatever their layouts (S4): each
    file once, every column in one agreed type (``agreed_type``), columns
    that a file lacks null, ``name=value`` folders as text columns.  One scan
    per layout.  A file that cannot be read is an error, as is no file."""
    files: dict[str, None] = {}
    parts: dict[str, None] = {}
    for root in sorted({_norm_path(p) for p in paths}):
        own = data_files(spark, root, recursive)
        parts |= dict.fromkeys(_partition_names(root, own))
        files |= dict.fromkeys(own)
    found, failed = layouts(spark, list(files))
    if failed:
        raise OSError("; ".join(f"{p}: {why}" for p, why in failed[:5]))
    if not found:
        raise FileNotFoundError("no Parquet file in " + ", ".join(paths))
    spelled: dict[str, str] = {}
    held: dict[str, list[T.DataType]] = {}
    for layout in found:
        for f in layout.schema.fields:
            spelled.setdefault(f.name.lower(), f.name)
            held.setdefault(f.name.lower(), []).append(f.dataType)
    taken = {p.lower() for p in parts}
    types = {low: agreed_type(ts) for low, ts in held.items() if low not in taken}
    out = None
    for layout in found:
        df = spark.read.schema(layout.schema).parquet(*layout.paths)
        have = {f.name.lower(): f for f in layout.schema.fields}
        cols = [(as_type(have[low].name, have[low].dataType, t) if low in have else F.lit(None).cast(t)).alias(spelled[low])
                for low, t in types.items()]
        part = df.select(*cols, *[_partition_value(p).alias(p) for p in parts])
        out = part if out is None else out.unionByName(part)
    return out
