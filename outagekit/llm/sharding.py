"""Sharding by a two-pass external shuffle (operator 11).

First pass: every record is scattered into one of many buckets by a seeded
hash of its document id and its place in the table, so copies, null ids and
repeated rows spread evenly; the number of buckets is taken from the table's
bytes and rows, so that a bucket fits in a task's memory at every size.
Second pass: each bucket is put into hash order and then shuffled by Fisher
and Yates' exchanges, drawn from a hash keyed by (seed, bucket, step).  The
buckets one after the other are one random order of the whole table, which is
cut into shards of equal row counts (the law ``rows``).

Records cross the network once, by bucket.  The exchanges are done on the
bucket's positions - four bytes each in one binary value - which depend on its
row count alone, so they are drawn beside the records and joined to them on
the same partitioning.  Everything is DataFrame expressions; the same table
and seed give the same shards, whatever the partitions, and a task that runs
again repeats its draws.

Defined results: null text has size 16 and the crc32 of no bytes; empty and
very long texts, null ids and repeated rows are records like any other; an
empty table has no shards' rows; with fewer rows than shards some shards are
empty; an input column named ``shard`` or ``slot`` is replaced.  The order
depends on the number of a row in its file and on the file's number, so a
table written anew into other files is another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagekit.llm.common import cut, located_rows, table

SHARDS, SEED = 40, 20_240_611
#: A bucket's size: its records are sorted in one task's memory.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 4096
#: Buckets whose counts are added up in one step of the running total.
STRIDE = 4096
#: The random part that Spark gives to the names of a folder's files.
UUID = r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def record_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets that hold about ``bucket_bytes`` and ``bucket_rows`` at most."""
    n, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(record_size("text")), F.lit(0))).first()
    return max(1, -(-n // bucket_rows), -(-size // bucket_bytes))


def scattered(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """First pass: __doc (the record), __file, __row, ``h`` and ``bucket``."""
    rows = located_rows(docs)
    name = F.regexp_replace(F.element_at(F.split("__file", "/"), -1), UUID, "")
    h = F.xxhash64(F.lit(seed).cast("long"), F.col("__doc.doc_id").cast("string"), name, F.col("__row").cast("long"))
    return rows.select("*", h.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets).cast("long")))


def offsets(counts: DataFrame) -> DataFrame:
    """``counts`` (bucket, n) with ``before``, the rows of all smaller
    buckets: summed within strides of buckets and over the strides."""
    strided = counts.withColumn("stride", F.floor(F.col("bucket") / STRIDE))
    def smaller(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = strided.groupBy("stride").agg(F.sum("n").alias("s"))
    ahead = sums.select("stride", smaller("s", Window.orderBy("stride")).alias("ahead"))
    inside = smaller("n", Window.partitionBy("stride").orderBy("bucket"))
    return (strided.withColumn("inside", inside).join(ahead, "stride")
            .select("bucket", "n", (F.col("ahead") + F.col("inside")).alias("before")))


def drawn_places(n: Column, bucket: Column, seed: int = SEED) -> Column:
    """The places 0 to n-1 after Fisher and Yates' exchanges, four bytes
    each.  Step i (from n-1 down to 1) exchanges place i with place
    ``hash(seed, bucket, i) mod (i + 1)``."""
    identity = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lpad(F.hex(k), 8, "0")), ""))

    def exchange(places: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed).cast("long"), bucket, i.cast("long")), (i + 1).cast("long")).cast("int")
        at = lambda k: places.substr(4 * k + 1, F.lit(4))
        return F.overlay(F.overlay(places, at(i), 4 * j + 1, F.lit(4)), at(j), 4 * i + 1, F.lit(4))

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, identity, exchange)


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each record of ``docs`` once: __doc (its columns), ``bucket``, ``at``
    (its place in the whole random order, from 0) and ``n_rows``."""
    buckets = bucket_count(docs, bucket_bytes, bucket_rows)
    rows = scattered(docs, buckets, seed)
    counts = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n")), buckets)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = offsets(counts).withColumn("places", drawn_places(F.col("n"), F.col("bucket"), seed))
    in_bucket = Window.partitionBy("bucket").orderBy("h", "__file", "__row")
    numbered = rows.select("__doc", "bucket", F.row_number().over(in_bucket).alias("i"))
    place = F.conv(F.hex(F.col("places").substr(4 * (F.col("i") - 1) + 1, F.lit(4))), 16, 10).cast("long")
    return numbered.join(drawn, "bucket").select(
        "__doc", "bucket", (F.col("before") + place).alias("at"), F.lit(total).cast("long").alias("n_rows"))


def sharded(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (its place in the shard)."""
    placed = shuffled(docs, **how).withColumn("shard", F.expr(f"(at * {shards}L) div n_rows"))
    slot = F.col("at") - F.expr(f"(shard * n_rows + {shards - 1}L) div {shards}L")
    own = [F.col(f"__doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*own, F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """Write the shards as folders ``shard=N`` of Parquet files.  A bucket's
    records go to one file of a shard (two where a shard ends in it), in the
    order of ``slot``; the files of a shard hold its slots once."""
    out = sharded(docs, shards, **how)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", record_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
