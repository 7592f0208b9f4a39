"""Session helpers.

The library never creates its own cluster settings for production use: it
reads what the session already has.  ``get_spark`` is for tests, the bench
and local runs; it pins the session time zone to UTC (all interval tables
are zone-less) and turns AQE on so shuffles are coalesced and skewed joins
split at run time.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "outagekit") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged tables: the one the session
    has (``spark.checkpoint.dir``, or set on its context).  A session whose
    tasks all run in the driver's own process (``local``) may lack one; its
    local folder is shared by definition, so a scratch folder is set.  On a
    cluster a missing folder is an error, raised before any work."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("this operator needs a folder that all executors share: set spark.checkpoint.dir")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="outagekit-ckpt-"))
    return sc.getCheckpointDir()
