"""SimHash near-duplicates by vantage-point trees (operator 7).

Fingerprint: A-Z lower-cased text, words, ``k``-word shingles (repeats
included), XXH64 (seed 42) of each; a bit of the fingerprint is 1 where it is
set in over half of the hashes.  Distinct fingerprints are then shared out by
a vantage-point tree: a node sends the fingerprints within its radius of its
vantage point one way and the others the other way.  The triangle inequality
says which leaves can hold a neighbour within ``r`` bits: a fingerprint that
lies within ``r`` of a node's boundary also visits the other side.  Each leaf
(shard) searches its fingerprints and its visitors with vantage-point trees
of its own and is exact, so all pairs within ``r`` bits are found, each in
one shard: a fingerprint only visits leaves before its own.

Pairs do not leave a shard: it joins them into groups and sends one edge per
member.  Connected components over these edges give the classes.

Defined results: null or wordless text has fingerprint 0 and is linked like
any other; fewer words than ``k`` are one shingle; rows with equal
fingerprints are one class; ``component_id`` is the smallest doc_id that is
not null (null if all are); an empty table gives an empty result; other
columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import cut, located, located_rows, table
from outagekit.operators.joins import broadcast_bounded

K, RADIUS = 3, 3
#: Fingerprints aimed at in a shard, and the most levels of the shard tree
#: (its nodes, at most 2 ** LEVELS * 9 bytes, go to every task).
SHARD, LEVELS = 4096, 16
#: Fingerprints the vantage points and radii are taken from (about so many;
#: the tree shares out every fingerprint, whatever the sample).
SAMPLE = 20000
#: A shard's own trees end at so many fingerprints.
LEAF = 48


def fingerprint(text: str | None, k: int = K) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    hi = (ends[k - 1:] - 1).tolist()
    lo = [0, *ends[:n - k].tolist()]
    h, digest = [], xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), n - k + 1
    for at in range(0, total, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at:at + 65536], hi[at:at + 65536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py(), k) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__f"), b.column("__row"), pa.array(fp)],
                                         names=["doc_id", "__f", "__row", "fp"])


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, __f, __row and ``fp`` (64 bits as a signed long)."""
    d = located(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), F.xxhash64("__file").alias("__f"), "__row", "text")
    return d.mapInArrow(lambda it: _fingerprints(it, k), "doc_id long, __f long, __row long, fp long")


# --- vantage-point trees -----------------------------------------------------

def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shard_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree of ``levels`` levels, node i with
    children 2i and 2i + 1.  A point of the sample is the vantage point of
    its node, the median distance to it the radius."""
    vp, rad = np.zeros(1 << levels, np.uint64), np.zeros(1 << levels, np.int16)

    def grow(node: int, pts: np.ndarray, level: int) -> None:
        if level == levels:
            return
        vp[node] = pts[0] if len(pts) else 0
        d = _bits(pts ^ vp[node])
        rad[node] = int(np.median(d)) if len(pts) else 32
        grow(2 * node, pts[d <= rad[node]][1:], level + 1)
        grow(2 * node + 1, pts[d > rad[node]], level + 1)

    if levels:
        grow(1, sample, 0)
    return vp, rad


def route(fp: np.ndarray, vp: np.ndarray, rad: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, leaf, is home) of every leaf that a fingerprint lives
    in or visits; visits only to leaves before the home."""
    idx, node, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
    for _ in range(levels):
        d, r = _bits(fp[idx] ^ vp[node]).astype(np.int16), rad[node]
        inner = d <= r
        both = np.where(inner, d + radius > r, d - radius <= r)
        own, other = 2 * node + ~inner, (2 * node + inner)[both]
        idx, node, home = np.concatenate([idx, idx[both]]), np.concatenate([own, other]), np.concatenate([home, np.zeros(len(other), bool)])
    homes = np.zeros(len(fp), np.int64)
    homes[idx[home]] = node[home]
    keep = home | (node < homes[idx])
    return idx[keep], node[keep], home[keep]


def _route(batches: Iterator[pa.RecordBatch], tree: tuple, levels: int, radius: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 2048):
            i, leaf, home = route(fp[at:at + 2048], *tree, levels, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at:at + 2048][i].view(np.int64)), pa.array(home)],
                                             names=["leaf", "fp", "home"])


def near_pairs(x: np.ndarray, pts: np.ndarray, seek: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, seeker) of ``x`` within ``radius`` bits: points
    are split by a vantage point, seekers follow where the triangle bound
    allows a neighbour, small leaves are compared whole."""
    if not len(pts) or not len(seek):
        return
    if len(pts) > LEAF:
        v = x[pts[len(pts) // 2]]
        d, ds = _bits(x[pts] ^ v).astype(np.int16), _bits(x[seek] ^ v).astype(np.int16)
        r = int(np.median(d))
        if (d > r).any() or not (d < r).any():
            inner = d <= r
        else:
            inner, r = d < r, r - 1
        if inner.any() and not inner.all():
            yield from near_pairs(x, pts[inner], seek[ds - radius <= r], radius)
            yield from near_pairs(x, pts[~inner], seek[ds + radius > r], radius)
            return
    for at in range(0, len(seek), 1 << 14):
        part = seek[at:at + (1 << 14)]
        p, s = np.nonzero(_bits(x[pts][:, None] ^ x[part][None, :]) <= radius)
        yield pts[p], part[s]


class Groups:
    """Union of index pairs; the smallest index stands for a group."""

    def __init__(self, n: int):
        self.top, self.todo, self.size = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.todo.append((i, j))
        self.size += len(i)
        if self.size > 200_000:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.todo:
            i, j = (np.concatenate(c) for c in zip(*self.todo))
            while True:
                a, b = self.top[i], self.top[j]
                open_ = a != b
                if not open_.any():
                    break
                i, j = i[open_], j[open_]
                np.minimum.at(self.top, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
                while not (self.top == (up := self.top[self.top])).all():
                    self.top = up
        self.todo, self.size = [], 0
        return self.top


def _shard_edges(group: pa.Table, radius: int) -> pa.Table:
    fp = group.column("fp").to_numpy().view(np.uint64)
    home = group.column("home").to_numpy(zero_copy_only=False)
    groups = Groups(len(fp))
    for p, s in near_pairs(fp, np.flatnonzero(home), np.arange(len(fp)), radius):
        off = p != s
        groups.add(p[off], s[off])
    top = groups.settle()
    m = np.flatnonzero(top != np.arange(len(fp)))
    return pa.table({"a": fp[m].view(np.int64), "b": fp[top[m]].view(np.int64)})


def near_edges(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect every two of the ``n`` distinct ``fp``
    within ``radius`` bits, directly or by way of others."""
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / SHARD)))))
    pick = F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(max(1, n // SAMPLE))) == 0
    rows = distinct.where(pick).select("fp").limit(2 * SAMPLE).collect() if levels else []
    # in order of another hash, so the vantage points do not depend on the order of arrival
    sample = np.array(sorted((xxhash.xxh64_intdigest(str(r[0])), r[0]) for r in rows) or np.zeros((0, 2)), object)[:, 1]
    tree = shard_tree(sample.astype(np.int64).view(np.uint64), levels)
    dealt = distinct.select("fp").mapInArrow(lambda it: _route(it, tree, levels, radius), "leaf long, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(lambda t: _shard_edges(t, radius), "a long, b long")


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (a, b), about ``n`` at most:
    ``root`` is the smallest vertex of its component.  Each round takes the smallest label
    of the neighbours, then the label's own label; a round's table is
    checkpointed, its number of changes is all the driver sees."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut(edges.select(F.inline(both)).distinct(), n and 2 * n)
    labels = cut(e.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("root")), n)
    while True:
        near = (e.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("root").alias("near")))
        low = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
        new = cut(low.join(hop, "root").select("v", F.least("root", "up").alias("root"), "old"), n)
        changed = new.where("root <> old").count()
        labels = new.select("v", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, k: int = K, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id,
    kept (the one row of its class that stays: smallest doc_id), __f, __row."""
    rows = cut(fingerprints(docs, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__f", "__row"))
    distinct = cut(rows.groupBy("fp").agg(first.alias("head")), rows.count())
    n = distinct.count()
    root = components(near_edges(distinct, n, radius), n).withColumnRenamed("v", "fp")
    classes = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = classes.groupBy("root").agg(F.min("head").alias("top"))
    of_fp = classes.join(heads, "root").select("fp", "top")
    mine = (F.col("top.__f") == F.col("__f")) & (F.col("top.__row") == F.col("__row"))
    return rows.join(of_fp, "fp").select("doc_id", "fp", F.col("top.doc_id").alias("component_id"), mine.alias("kept"), "__f", "__row")


def drop_near_duplicates(docs: DataFrame, k: int = K, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each class, all columns kept."""
    whole = located_rows(docs).withColumn("__f", F.xxhash64("__file"))
    gone = cut(near_duplicates(whole.select("__doc.*"), k, radius).where("not kept").select("__f", "__row"))
    return whole.join(broadcast_bounded(gone), ["__f", "__row"], "left_anti").select("__doc.*")


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
