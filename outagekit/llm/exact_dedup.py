"""Exact de-duplication with streaming keyed state (operator 8).

Documents are equal when their texts are identical after lower-casing A-Z.
One batch pass stages (doc_id, digest, locator) of every row; a Structured
Streaming aggregate keyed by the digest reads the staged rows and keeps, per
digest, the stable identifier (largest doc_id), the content locator (file
and row of that document) and the number of rows.  Its state lives in
RocksDB - on disk, snapshots in the shared folder - and has no watermark, so
nothing expires; staging more documents into the same folders and running
again resumes the state with the new rows only.  Full bytes are then compared
for every digest that was hit more than once; should two texts share a
digest, its rows are grouped by their bytes instead.

Defined results: null text counts as empty; a null doc_id ranks below any
other; of repeated rows (same doc_id, same text) one stays, the one last in
(file, row) order; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import ascii_lower, fresh_dir, located, located_rows, table
from outagekit.operators.joins import broadcast_bounded

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Digest = Callable[[Column], Column]


def normal_text(text: str = "text") -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stage_digests(docs: DataFrame, path: str, digest: Digest = sha256) -> DataFrame:
    """Append (doc_id, digest, __file, __row) of ``docs`` to the folder the
    stream reads.  ``docs`` comes from ``located``."""
    docs.select("doc_id", digest(normal_text()).alias("digest"), "__file", "__row").write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def update_state(spark: SparkSession, staged: DataFrame, staged_path: str, state_path: str) -> DataFrame:
    """Run the keyed state over what is staged and not yet seen; returns
    (digest, keep{doc_id, __file, __row}, n), read back from the state."""
    s = spark.newSession()  # the state store settings stay out of the caller's session
    s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")  # of an executor; the state is on disk
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4")
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else 4 MB or more a partition, unused
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # one file a partition and run
    rows = s.readStream.schema(staged.schema).parquet(staged_path)
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "__file", "__row")), F.count(F.lit(1)))
    query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    kept = f"{state_path}-read-{query.runId}"
    if query.lastProgress is None and not staged.take(1):
        return spark.createDataFrame([], staged.select(
            "digest", F.struct("doc_id", "__file", "__row").alias("keep"), F.lit(1).cast("long").alias("n")).schema)
    (s.read.format("statestore").load(state_path)
     .select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n")).write.parquet(kept))
    return spark.read.parquet(kept)


def collided(docs: DataFrame, hits: DataFrame, digest: Digest = sha256) -> DataFrame:
    """Digests among ``hits`` whose documents' bytes are not all the same.
    The smallest and the largest text of a digest are equal only if all are;
    both combine before the shuffle, so a large group stays small."""
    t = docs.select(digest(normal_text()).alias("digest"), normal_text().alias("t"))
    return (t.join(hits, "digest", "left_semi").groupBy("digest")
            .agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("digest"))


def exact_dedup(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size,
    kept, __file, __row."""
    spark = docs.sparkSession
    docs = located(docs.select("doc_id", "text"))
    staged_path, state_path = fresh_dir(spark, "staged"), fresh_dir(spark, "state")
    rows = stage_digests(docs, staged_path, digest)
    state = update_state(spark, rows, staged_path, state_path)
    multi = broadcast_bounded(state.where("n > 1"))
    bad = collided(docs, multi.select("digest"), digest)
    bad.write.parquet(bad_path := fresh_dir(spark, "collided"))
    bad = spark.read.schema("digest string").parquet(bad_path)

    if bad.take(1):
        multi = broadcast_bounded(state.where("n > 1").join(bad, "digest", "left_anti"))
        whole = docs.select("*", digest(normal_text()).alias("digest"), normal_text().alias("t")).join(bad, "digest", "left_semi")
        by_text = whole.groupBy("digest", "t").agg(F.max(F.struct("doc_id", "__file", "__row")).alias("keep"),
                                                   F.count(F.lit(1)).alias("n"))
        regrouped = whole.join(by_text, ["digest", "t"]).select("doc_id", "digest", "__file", "__row", "keep", "n")
        rows = rows.join(bad, "digest", "left_anti")
    else:
        regrouped = None
    out = rows.join(multi, "digest", "left").select("doc_id", "digest", "__file", "__row", "keep", "n")
    if regrouped is not None:
        out = out.unionByName(regrouped)
    alone = F.col("keep").isNull()
    return out.select(
        "doc_id", "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("keep.__file") == F.col("__file")) & (F.col("keep.__row") == F.col("__row")))).alias("kept"),
        "__file", "__row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without its copies, all columns kept (the pipeline's stage)."""
    whole = located_rows(docs)
    gone = exact_dedup(whole.select("__doc.*")).where("not kept").select("__file", "__row")
    return whole.join(broadcast_bounded(gone), ["__file", "__row"], "left_anti").select("__doc.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
