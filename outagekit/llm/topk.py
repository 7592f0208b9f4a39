"""Exact top-k search by no-random-access aggregation (operator 4).

Vector components become floor(256 * x); the score of a pair is the integer
inner product.  Candidates are dealt into blocks.  Within a block every
dimension is a list sorted by component, read from its good end: the top for
a positive query component, the bottom for a negative one.  After reading to
a depth, a candidate's score has a lower bound (what was read, and the worst
of each list for the rest) and an upper bound (the list's frontier for the
rest).  Candidates whose upper bound is below the k-th best lower bound cannot
qualify and are dropped.  The depth doubles from a 16th of the lists up to
half, then halves what is unread, to the end; each query stops when k
candidates are left, or all that are left have exact scores.  The survivors'
scores are then resolved.  A block gives
each query its k best, and the best of all blocks follow by rank.

Queries (rows whose id is divisible by ``step``) are sent in blocks of their
own to groups of blocks of candidates, one copy a group, and meet them in a
merge join: the copies together grow faster than either table, so neither side
is ever broadcast, whatever size Spark expects it to have.

Defined results: vectors that are null, or hold null or non-finite
components, and rows without an id take no part; shorter vectors count as
filled with zeros; repeated rows (same id and vector) are one candidate and
one query, and no row of a query's id is its candidate; ties go to the
smaller id; a score among the best that is no 64-bit integer is an error; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagekit.llm.common import cut, table

TOP, STEP, SCALE = 5, 50, 256
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 512
#: Components of the candidates of a group at most, and groups to have before any gets a second block.
GROUP, SPREAD = 2 ** 23, 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Distinct (vec_id, q) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select("vec_id", q.alias("q")).distinct()


def _matrix(col) -> np.ndarray:
    long = set(col.value_lengths().to_pylist())
    if len(long) == 1:
        return np.asarray(col.flatten(), np.int64).reshape(len(col), long.pop())
    rows = [np.asarray(r.values) for r in col]
    d = max((len(r) for r in rows), default=0)
    return np.array([r if len(r) == d else np.pad(r, (0, d - len(r))) for r in rows], np.int64).reshape(len(rows), d)


class Lists:
    """The sorted lists of a block of candidates, read for many queries at
    once: a depth is the same for all, so the bounds are matrix products."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, kind: type):
        self.ids, self.n = ids, len(ids)
        self.c = c.astype(kind)
        order = np.argsort(c, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.c, order, 0)
        self.rank = np.empty(c.shape, np.int32)  # place of a candidate in each list, from the bottom
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) after reading
        ``depth`` entries of each list: from the top for the positive query
        components ``up``, from the bottom for the negative ones ``down``."""
        seen = np.hstack([self.rank >= self.n - depth, self.rank < depth])
        parts, read = np.hstack([up, down]), np.hstack([self.c, self.c])
        worst = np.concatenate([self.sorted[0], self.sorted[-1]])
        front = np.concatenate([self.sorted[self.n - depth], self.sorted[depth - 1]])
        return parts @ np.where(seen, read, worst).T, parts @ np.where(seen, read, front).T

    def best(self, qids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best (ids, scores) of each query, its own id left out."""
        q = q.astype(self.c.dtype)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        own = self.ids == qids[:, None]
        alive = ~own
        k = min(k, self.n)
        depth, reading = max(1, self.n // 16), np.arange(len(qids))
        while depth < self.n and len(reading):
            low, high = self.bounds(depth, up[reading], down[reading])
            low[own[reading]] = np.iinfo(np.int64).min if low.dtype == np.int64 else -np.inf
            bar = np.partition(low, self.n - k, axis=1)[:, self.n - k]
            left = alive[reading] & (high >= bar[:, None])  # an outsider below the k-th best lower bound cannot qualify
            alive[reading] = left
            # a query is read no more when only k are left, or the others tie with them for certain
            sure = (left & (low < high)).sum(1) == 0
            reading = reading[~sure & (left.sum(1) > k)]
            depth = min(2 * depth, depth + (self.n - depth + 1) // 2)
        out = []
        for i in range(len(qids)):  # the scores of what is left are resolved
            left = np.flatnonzero(alive[i])
            score = self.c[left] @ q[i]
            if len(left) > 4 * k:
                some = score >= np.partition(score, len(left) - k)[len(left) - k]
                left, score = left[some], score[some]
            if score.dtype == object:
                top = np.array(sorted(range(len(left)), key=lambda j: (-score[j], self.ids[left[j]]))[:k], np.int64)
            else:
                top = np.lexsort((self.ids[left], -score))[:k]
            out.append((self.ids[left][top], score[top].astype(np.int64)))
        return out


def exact_kind(c: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which sums of the products are exact: floats below
    their limit, then 64-bit, then Python's integers."""
    most = [max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in (c, q)]
    largest = most[0] * most[1] * max(1, c.shape[1])
    return np.float32 if largest < 2 ** 24 else np.float64 if largest < 2 ** 53 else np.int64 if largest < 2 ** 63 else object


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    lists = None
    for b in batches:
        for i in range(b.num_rows):
            ids, qids = (np.asarray(b.column(c)[i].values) for c in ("ids", "qids"))
            c, q = _matrix(b.column("vecs")[i].values), _matrix(b.column("qvecs")[i].values)
            d = max(c.shape[1], q.shape[1])
            c, q = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (c, q))
            kind = exact_kind(c, q)  # the lists of a block serve all blocks of queries that follow each other
            if lists is None or lists.c.dtype != kind or not (np.array_equal(lists.ids, ids) and np.array_equal(lists.c, c)):
                lists = Lists(ids.copy(), c, kind)
            found = lists.best(qids, q, k)
            per = [len(f) for f, _ in found]
            marks = [int(xxhash.xxh64_intdigest(row.tobytes()) >> 1) for row in q]
            cols = [np.repeat(qids, per), np.repeat(np.array(marks, np.int64), per),
                    np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "qh", "vec_id", "score"])


def packed(rows: DataFrame, n: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows in ``n`` blocks: block, ids, vectors."""
    block = F.pmod(F.xxhash64("vec_id", "q"), F.lit(n))
    both = F.array_sort(F.collect_list(F.struct("vec_id", "q")))
    return (rows.groupBy(block.cast("int").alias(names[0])).agg(both.alias("b"))
            .select(names[0], F.col("b.vec_id").alias(names[1]), F.col("b.q").alias(names[2])))


def grouped(blocks: int, d: int, tasks: int = 0) -> int:
    """Groups that so many blocks of candidates of ``d`` components are dealt
    into: each gets a copy of the queries, so there are no more than keep
    ``tasks`` busy, or than groups of ``GROUP`` components make."""
    most = max(1, GROUP // (CANDIDATES * max(1, d)))
    return -(-blocks // min(most, max(1, blocks // max(SPREAD, tasks))))


def top_k(vectors: DataFrame, k: int = TOP, step: int = STEP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best per query."""
    rows = cut(quantised(vectors, scale))
    asked = rows.where(F.col("vec_id") % step == 0)
    n, d = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks, qblocks = max(1, -(-n // CANDIDATES)), max(1, -(-asked.count() // QUERIES))
    groups = grouped(blocks, d or 0, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    cands, key = packed(rows, blocks, ("block", "ids", "vecs")), "block"
    if groups < blocks:
        cands, key = cands.withColumn("group", F.col("block") % groups), "group"
    sent = packed(asked, qblocks, ("qblock", "qids", "qvecs")).withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # for each row of the left side a merge join holds those of the right: few blocks, however many queries there are
    found = sent.join(cands.hint("merge"), key).select("ids", "vecs", "qids", "qvecs").mapInArrow(
        lambda it: _search(it, k), "query_id long, qh long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % {STEP} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
