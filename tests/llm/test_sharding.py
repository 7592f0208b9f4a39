"""The two-pass shuffle against its plain form."""

import collections
import struct
import zlib

import pandas as pd
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from outagekit.llm import sharding

from .conftest import SF


def signed(*parts, seed=42):
    """Spark's 64-bit hash of longs and strings (nulls pass)."""
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_order(rows, buckets, seed):
    """(doc_id, file, row) of every record in shuffled order."""
    held = collections.defaultdict(list)
    for doc_id, file, row in rows:
        h = signed(seed, None if doc_id is None else str(doc_id), file, row)
        held[h % buckets].append((h, file, row, doc_id))
    out = []
    for b in sorted(held):
        mine = sorted(held[b])
        places = list(range(len(mine)))
        for i in range(len(mine) - 1, 0, -1):
            j = signed(seed, b, i) % (i + 1)
            places[i], places[j] = places[j], places[i]
        at = [None] * len(mine)
        for record, p in zip(mine, places):
            at[p] = record
        out += [(r[3], r[1], r[2]) for r in at]
    return out


def test_query_puts_every_document_once(spark):
    got = E.queries()["op11_external_shuffle"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    both = docs.merge(got, on="doc_id")
    assert len(got) == len(docs) == len(both)
    data = [(t or "").encode() for t in both.text]
    assert both["size"].tolist() == [len(d) + 16 for d in data]
    assert both.text_crc32.tolist() == [zlib.crc32(d) for d in data]
    assert set(got["law"]) == {"rows"} and got.grown_shard.isna().all()
    counts = got.shard.value_counts()
    assert set(counts.index) == set(range(40)) and counts.max() - counts.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    again = E.queries()["op11_external_shuffle"](spark, SF).toPandas()
    key = ["shard", "slot"]
    assert got.sort_values(key)["doc_id"].tolist() == again.sort_values(key)["doc_id"].tolist()


def test_order_is_the_plain_shuffle(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for buckets, how in ((1, {}), (-(-len(docs) // 23), {"bucket_rows": 23})):
        want = plain_order([(i, "documents.parquet", k) for k, i in enumerate(docs.doc_id.tolist())], buckets, sharding.SEED)
        out = sharding.sharded(spark.read.parquet(f"{SF}/documents.parquet"), 7, **how).toPandas()
        assert out.sort_values(["shard", "slot"]).doc_id.tolist() == [w[0] for w in want]


def test_running_totals_over_strides(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 3)
    counts = [(b, 1 + b % 4) for b in range(0, 40, 2)]
    got = {r.bucket: r.before for r in sharding.offsets(spark.createDataFrame(counts, "bucket long, n int")).collect()}
    assert got == {b: sum(n for x, n in counts if x < b) for b, _ in counts}


def test_odd_rows(spark, odd_docs, no_docs):
    for how in ({}, {"bucket_rows": 4}, {"bucket_bytes": 1 << 16}):
        rows = sharding.sharded(odd_docs, 5, **how).collect()
        told = lambda rs: collections.Counter((r.doc_id, r.text, r["size"], r["__doc"]) for r in rs)
        assert told(rows) == told(odd_docs.collect())
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.sharded(no_docs).count() == 0
    few = sharding.sharded(odd_docs.limit(3), 40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    named = sharding.sharded(odd_docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")), 4)
    assert dict(named.dtypes)["shard"] == "int" and dict(named.dtypes)["slot"] == "bigint"


def test_one_repeated_row_spreads_over_all_buckets(spark):
    """Nearly all rows are one row: no bucket and no shard grows for it."""
    rows = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    sizes = [r.n for r in sharding.shuffled(rows, bucket_rows=100).groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) < 160


def test_written_shards_hold_the_records_in_order(spark, odd_docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd_docs, path, 3, bucket_rows=5)
    back = spark.read.parquet(path)
    told = lambda df: collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in df.collect())
    assert sum(told(back).values()) == odd_docs.count() and set(back.columns) == {*odd_docs.columns, "shard", "slot"}
    for _, g in back.select("shard", "slot", F.input_file_name().alias("f")).toPandas().groupby("f", sort=False):
        assert g.slot.tolist() == sorted(g.slot)
