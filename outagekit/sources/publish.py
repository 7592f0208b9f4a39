"""Atomic publishing of processed tables and months (K1, K2).

A published table is a folder of data folders ``v=<id>/ano=YYYY/mes=MM`` and a
log of numbered commits.  A commit is one small JSON file that names, for every
month of the table, the data folder that holds it, so a commit replaces a
month, several months or the whole table in one step:

* a writer writes its rows to a data folder of its own, which no reader looks
  at, and then puts the next commit only if no file of that number exists;
* a reader takes the newest commit and reads the folders it names: the table
  before or after a publish, never a half-written month, also on an object
  store, where renaming or overwriting folders is not atomic;
* of two writers of the same month, exactly one wins, and the other gets
  ``PublishConflict``; writers of different months both win, the later one by
  putting its months on top of the other's commit.

Order comes from the commit numbers, not from the writers' clocks.  A killed
job leaves a data folder that no commit names; ``clean`` deletes such folders
and those of old commits once they are older than the given age.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.sources.io import _fs, add_month_partition

LOG = "_log"
PARTS = T.StructType([T.StructField(c, T.StringType()) for c in ("v", "ano", "mes")])


class PublishConflict(RuntimeError):
    """Another writer has published the same months since this one began."""


@dataclass(frozen=True)
class Commit:
    """Commit ``number`` (0: nothing published yet): the schema of the rows
    and, per month ``YYYY-MM``, its data folder."""

    number: int = 0
    schema: str | None = None
    months: dict[str, str] = field(default_factory=dict)


def _log_path(base: str, number: int) -> str:
    return f"{base.rstrip('/')}/{LOG}/{number:020d}.json"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text``; False if it exists.  Exactly one
    of several callers gets True.  On a cluster's file system this is
    ``create`` without overwrite; the local one only tests before it creates,
    so there a finished file is linked to the name."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    data = text.encode()
    if fs.getScheme() == "file":
        target = p.toUri().getPath()
        temp = f"{target}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as f:
            f.write(data)
        try:
            os.link(temp, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(data))
    try:
        out.close()  # object stores settle the condition when the object is complete
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "412" in str(e.java_exception):
            return False
        raise e
    return True


def _text(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit_files(spark: SparkSession, base: str) -> list:
    """(number, path) of the commits, oldest first."""
    fs, root = _fs(spark, f"{base.rstrip('/')}/{LOG}")
    if not fs.exists(root):
        return []
    named = [(st.getPath().getName(), st.getPath()) for st in fs.listStatus(root)]
    return sorted(((int(n[:-5]), p) for n, p in named if n.endswith(".json") and n[:-5].isdigit()), key=lambda c: c[0])


def _read_commit(spark: SparkSession, base: str, number: int, path) -> Commit | None:
    """The commit, or None while its writer has not finished the file."""
    fs, _ = _fs(spark, base)
    try:
        body = json.loads(_text(spark, fs, path))
    except ValueError:
        return None
    return Commit(number, body["schema"], body["months"])


def current(spark: SparkSession, base: str) -> Commit:
    """The newest finished commit."""
    for number, path in reversed(_commit_files(spark, base)):
        commit = _read_commit(spark, base, number, path)
        if commit:
            return commit
    return Commit()


def _written_months(spark: SparkSession, folder: str) -> list[str]:
    """Months of a data folder, from its sub-folders."""
    fs, root = _fs(spark, folder)
    out = []
    for year in fs.listStatus(root):
        if year.isDirectory() and year.getPath().getName().startswith("ano="):
            out += [f"{year.getPath().getName()[4:]}-{m.getPath().getName()[4:]}" for m in fs.listStatus(year.getPath())
                    if m.isDirectory()]
    return sorted(out)


def _publish(df: DataFrame, base: str, month_col: str, replaced: Callable[[Commit, list[str]], Iterable[str]],
             whole: bool) -> Commit:
    spark, base = df.sparkSession, base.rstrip("/")
    start = current(spark, base)
    schema = df.schema.json()
    folder = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    add_month_partition(df, month_col).write.mode("errorifexists").partitionBy("ano", "mes").parquet(f"{base}/v={folder}")
    written = _written_months(spark, f"{base}/v={folder}")
    seen = start
    while True:
        touched = set(replaced(seen, written))
        if seen.schema is not None and not whole and json.loads(seen.schema) != json.loads(schema):
            raise ValueError(f"columns differ from those published under {base}")
        if seen.number != start.number and (whole or any(seen.months.get(m) != start.months.get(m) for m in touched)):
            raise PublishConflict(f"{base}: commit {seen.number} has replaced the same months")
        months = {} if whole else {m: v for m, v in seen.months.items() if m not in touched}
        commit = Commit(seen.number + 1, schema, months | dict.fromkeys(written, folder))
        body = json.dumps({"schema": commit.schema, "months": commit.months}, sort_keys=True)
        if put_if_absent(spark, _log_path(base, commit.number), body):
            return commit
        seen = current(spark, base)
        if seen.number < commit.number:  # the file of that number is there, but not finished
            raise PublishConflict(f"{base}: commit {commit.number} is being written")


def publish_table(df: DataFrame, base: str, month_col: str) -> Commit:
    """Replace the whole table by ``df`` (K2).  Any commit since the start of
    this call is a conflict."""
    return _publish(df, base, month_col, lambda seen, written: {*seen.months, *written}, True)


def publish_months(df: DataFrame, base: str, month_col: str, months: Iterable[str] | None = None) -> Commit:
    """Replace the months (``YYYY-MM``) that ``df`` has rows of, and those named
    in ``months``, which lose their rows if ``df`` has none of them (K1).  The
    columns must be those of the published table.  Rows without a month are
    kept as a month of their own."""
    named = set(months or ())
    return _publish(df, base, month_col, lambda seen, written: named | set(written), False)


def read_published(spark: SparkSession, base: str, commit: Commit | None = None) -> DataFrame:
    """The published rows with ``ano`` and ``mes`` ('YYYY', 'MM'), by which a
    filter reads only the folders it needs.  With ``commit``, the table as of
    then."""
    base = base.rstrip("/")
    commit = commit or current(spark, base)
    if commit.schema is None:
        raise FileNotFoundError(f"nothing is published under {base}")
    rows = T.StructType.fromJson(json.loads(commit.schema))
    if not commit.months:
        return spark.createDataFrame([], T.StructType([*rows.fields, *PARTS.fields[1:]]))
    paths = []
    for month, folder in sorted(commit.months.items()):
        year, _, mes = month.rpartition("-")
        paths.append(f"{base}/v={folder}/ano={year}/mes={mes}")
    return (spark.read.option("basePath", base).schema(T.StructType([*rows.fields, *PARTS.fields]))
            .parquet(*paths).drop("v"))


def clean(spark: SparkSession, base: str, keep: int = 2, older_than_s: float = 7 * 86400) -> list[str]:
    """Delete the data folders that none of the newest ``keep`` commits names
    and that were last changed ``older_than_s`` ago or longer, which leaves
    those that a writer is still filling.  A commit file of that age that its
    writer never finished goes too (it holds the next number); the others
    stay as the table's history.  Returns the folders deleted."""
    base = base.rstrip("/")
    fs, root = _fs(spark, base)
    read = [_read_commit(spark, base, n, p) or p for n, p in reversed(_commit_files(spark, base))]
    for broken in (p for p in read if not isinstance(p, Commit)):
        if time.time() - fs.getFileStatus(broken).getModificationTime() / 1000 >= older_than_s:
            fs.delete(broken, False)
    live: set[str] = set()
    for commit in [c for c in read if isinstance(c, Commit)][:keep]:
        live |= set(commit.months.values())
    gone = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:] not in live and time.time() - _last_change(fs, st) / 1000 >= older_than_s:
            fs.delete(st.getPath(), True)
            gone.append(name[2:])
    return sorted(gone)


def _last_change(fs, status) -> int:
    """Newest change in a folder, in milliseconds: a folder's own time does
    not move while files are written below it."""
    newest, files = status.getModificationTime(), fs.listFiles(status.getPath(), True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def month_filter(anomes: str):
    """The partition filter of a month ``YYYY-MM``."""
    return (F.col("ano") == anomes[:4]) & (F.col("mes") == anomes[5:7])
