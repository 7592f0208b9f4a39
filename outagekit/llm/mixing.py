"""Mixing sources to target weights by the cube method (operator 1).

Every source gets a target number of words; a document of a source with
target / words = r is taken floor(r) times, and once more with inclusion
probability r - floor(r).  Which documents get the extra copy is decided by
balanced sampling: the flight phase of the cube method moves the
probabilities along the null space of the two balancing constraints of a
source - its number of documents and its words - until they are 0 or 1.
Three documents at a time suffice: their null-space direction is the cross
product of (1, 1, 1) and their sizes, and each step settles at least one.

The flight runs in blocks: rows are dealt by a hash into blocks, sorted by
(block, source, hash) and streamed, so a task holds three documents
at a time whatever the size of a source.  A block leaves at most two
undecided documents per source; these meet in ever fewer blocks and the
flight goes on.  In the last block it stops at ``LAND`` documents a source:
the landing lists their samples and takes the one whose words are nearest
the balance (then the one whose number of documents is).

All draws are keyed by (seed, level, block, source): reruns agree.

Defined results: null text has size 0; a null source is a source of its own,
last in order; sources without words have target 0 and are not taken; a null
doc_id is a document like others; each of repeated rows is a document; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagekit.llm.common import WORD, cut, located, located_rows, table
from outagekit.operators.joins import broadcast_bounded

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
#: Documents dealt to a block of the flight phase.
BLOCK = 8192
#: Documents a source's landing problem holds.
LAND = 12
EPS = 1e-9
UNIT = "doc_id long, __f long, __row long, sid long, size long, whole long, pi double, block long"


# --- targets -----------------------------------------------------------------

def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``sid``, the rank of ``key`` (from 0, by code point,
    null last).  Sorted range partitions are numbered one after the other;
    only their row counts reach the driver."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(key).asc_nulls_last()
    parts = cut(sources.repartitionByRange(n, by).withColumn("__p", F.spark_partition_id()))
    first, starts = 0, []
    for p, c in sorted(tuple(r) for r in parts.groupBy("__p").count().collect()):
        starts.append((p, first))
        first += c
    at = parts.sparkSession.createDataFrame(starts, "__p int, __first long")
    pos = F.row_number().over(Window.partitionBy("__p").orderBy(by))
    return parts.join(F.broadcast(at), "__p").withColumn("sid", F.col("__first") + pos - 1).drop("__p", "__first")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            limit: float = LIMIT) -> DataFrame:
    """``sources`` (source, source_size, sid) with ``target``: the share by
    weight, at most ``limit`` times the source's size, the excess reshared
    by weight among the others until none is above its limit.  Each round
    brings two sums to the driver."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * limit)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w")
        n, capped, open_w = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
                                  F.sum(F.when(~over, F.col("w")))).first()
        if n == full or not open_w:
            break
        full, level = n, (total * share - capped) / open_w
    target = F.least("cap", F.lit(level) * F.col("w")) if open_w else F.col("cap")
    return s.withColumn("target", target.cast("double")).drop("w", "cap")


# --- flight and landing ------------------------------------------------------

def _step(act: list[list], u: Sequence[float], rng: random.Random) -> None:
    """Move the probabilities (item 1 of each unit) along ``u`` or against
    it, as far as they go, unbiased; at least one becomes 0 or 1."""
    def reach(sign: int) -> tuple[float, int]:
        return min(((1 - a[1]) / (sign * x) if sign * x > 0 else a[1] / (-sign * x), i)
                   for i, (a, x) in enumerate(zip(act, u)) if x)

    (up, i), (down, j) = reach(1), reach(-1)
    sign, far, k = (1, up, i) if rng.random() * (up + down) < down else (-1, down, j)
    for a, x in zip(act, u):
        a[1] = a[1] + sign * far * x
        a[1] = 0.0 if a[1] < EPS else 1.0 if a[1] > 1 - EPS else a[1]
    act[k][1] = 1.0 if sign * u[k] > 0 else 0.0


def _flight(act: list[list], rng: random.Random) -> list[list]:
    """One step for the first three units (row, probability, size); what it
    settled leaves ``act``."""
    three = act[:3]
    a, b, c = (x[2] for x in three)
    _step(three, (c - b, a - c, b - a) if not a == b == c else (1, -1, 0), rng)
    act[:] = [x for x in act if x[1] not in (0.0, 1.0)]
    return [x for x in three if x[1] in (0.0, 1.0)]


def _landing(act: list[list]) -> list[list]:
    """Settle the last units of a source by the best of their samples."""
    p, size = np.array([x[1] for x in act]), np.array([x[2] for x in act], float)
    samples = (np.arange(1 << len(act))[:, None] >> np.arange(len(act))) & 1
    words, docs = np.abs((samples - p) @ size).round(6), np.abs((samples - p).sum(1)).round(6)
    for x, taken in zip(act, samples[np.lexsort((docs, words))[0]]):
        x[1] = float(taken)
    return act


def _fly(batches: Iterator[pa.RecordBatch], seed: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (block, source): settled units go out at once."""
    key, act, rng, schema = None, [], None, None
    hold = LAND if last else 2
    for batch in batches:
        schema = batch.schema
        names, out = schema.names, []
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        i_sid, i_size, i_pi, i_block = (names.index(c) for c in ("sid", "size", "pi", "block"))
        for row in zip(*cols):
            if key != (row[i_block], row[i_sid]):
                out += _landing(act) if last and act else act
                key, act = (row[i_block], row[i_sid]), []
                rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
            act.append([row, row[i_pi], row[i_size]])
            while len(act) > hold:
                out += _flight(act, rng)
        yield _batch(out, schema, i_pi)
    if act:
        yield _batch(_landing(act) if last else act, schema, schema.names.index("pi"))


def _batch(units: list[list], schema: pa.Schema, i_pi: int) -> pa.RecordBatch:
    cols = list(zip(*[u[0] for u in units])) or [()] * len(schema)
    cols[i_pi] = [u[1] for u in units]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def cube_sample(units: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """Settle the fractional ``pi`` of ``units`` (the columns of UNIT),
    balanced per ``sid`` on the number of units and on ``size``."""
    if blocks < 1:
        return units
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    frame = units.withColumn("block", F.pmod(h, F.lit(blocks)))
    settled, level = None, 0
    while True:
        last = blocks == 1
        # sizes mixed: what a block leaves gives the landing some choice
        frame = frame.repartition("block").sortWithinPartitions("block", "sid", h, "doc_id", "__f", "__row")
        flown = cut(frame.mapInArrow(lambda it, a=level, b=last: _fly(it, seed, a, b), UNIT))
        done = flown.where("pi in (0, 1)")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            return settled
        blocks = -(-blocks // BLOCK)
        level += 1
        frame = flown.where("pi not in (0, 1)").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "block"), F.lit(blocks)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT,
        seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source,
    size, source_size, target, copies, taken, __f, __row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(located(docs.select("doc_id", "source", "text")).select(
        F.col("doc_id").cast("long"), "source", size.alias("size"), F.xxhash64("__file").alias("__f"), "__row"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = cut(targets(ranked(per, "source"), weights, share, limit))
    n = per.agg(F.sum("n")).first()[0] or 0
    small = broadcast_bounded(per.select(F.col("source").alias("__s"), "source_size", "sid", "target"))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (rows.join(small, F.col("source").eqNullSafe(F.col("__s"))).withColumn("r", r)
             .withColumn("whole", F.floor("r").cast("long")).withColumn("pi", F.col("r") - F.col("whole"))
             .withColumn("block", F.lit(0).cast("long")))
    names = [c.split()[0] for c in UNIT.split(", ")]
    still = units.where("pi = 0").select(*names)
    moved = cube_sample(units.where("pi > 0").select(*names), -(-n // BLOCK), seed)
    copies = (F.col("whole") + F.col("pi")).cast("long")
    back = broadcast_bounded(per.select("sid", "source", "source_size", "target"))
    return (still.unionByName(moved).join(back, "sid")
            .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                    copies.alias("copies"), (copies * F.col("size")).alias("taken"), "__f", "__row"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    whole = located_rows(docs).withColumn("__f", F.xxhash64("__file"))
    took = (mix(whole.select("__doc.*"), **options).where("copies > 0")
            .select("__f", "__row", F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias("__copies")))
    return (whole.join(took, ["__f", "__row"]).select("__doc", F.explode("__copies").alias("__copy")).select("__doc.*"))


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
