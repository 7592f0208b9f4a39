"""Toxicity by a convolutional text classifier (operator 10).

A word's vector is the sum of hashed embeddings of the word and of its first
four and five bytes.  Filters of width 1, 2 and 3 run over the words of the
whole text, each keeps its maximum, and a linear layer turns the maxima into
one logit.  The network learns from every labelled document: in each round
tasks start from one network, learn from a part of about PART documents each,
and a second shuffle averages what they learnt (an embedding over the tasks
that met its words).  The driver holds one network, whose size is fixed.  A
fifth of the documents is held back: there the logit that parts the labels
best becomes the score 0.7, and thresholds are calibrated by language on that
scale, from counts over all of the fifth by 1/256 of a logit.  Tasks score
with the convolutions applied to the embedding table beforehand, so a word
costs one row of that table.

Scores depend on the text alone.  Labels only come from the rows the caller
passes (``op10`` leaves out the held-out third).

Defined results: null text counts as empty, and an empty text has the score
of no filter firing; labels that are null are left out, and a document with
several takes the largest; without both labels the score is the mean label
(0 without any); a null language, or one with too few labelled documents,
has the common threshold; repeated rows are scored alike and learnt from
alike; an empty table gives an empty result; other columns are passed through
or not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.llm.common import cut, table

#: Labelled documents of each label in ``labelled_sample``, at most about (no query is fitted to it).
POSITIVE, NEGATIVE = 1500, 2500
#: Labelled documents are dealt to so many folds: thresholds are set on the first, each other one is a round of learning.
FOLDS = 5
#: Documents that a task learns from in a round, about; words of them that it holds at once.
PART, HELD = 8192, 2_000_000
#: Few documents are gone through several times, until the network has met so many.
MEETINGS = 40_000
#: Words of a step, about (a longer document is a step of its own).
STEP_WORDS = 40_000
#: Embeddings that are averaged together; bins of a logit.
CHUNK, BINS = 2048, 256
BUCKETS, DIM = 1 << 15, 16
FILTERS = {1: 16, 2: 8, 3: 8}
STEPS, BATCH, RATE, EMB_RATE, SEED = 900, 32, 0.05, 0.3, 5
#: Share of the words hidden at a training step, so no single one is relied on.
HIDE = 0.5
CUT = 0.7
#: Labelled documents a language needs for a threshold of its own.
ENOUGH = 30
#: Words whose rows a task remembers.
REMEMBERED = 1 << 16
DROP = b".,;:!?()\"'"
PARTS = 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(None, DROP).split()


def parts_of(word: bytes) -> tuple[int, int, int]:
    return crc32(word) % BUCKETS, crc32(word[:4], 1) % BUCKETS, crc32(word[:5], 2) % BUCKETS


# --- training sample ---------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> list:
    """Rows (doc_id, toxic, lang, hashed words) of about ``positive`` +
    ``negative`` documents at most (never over twice that), picked by a hash
    of the doc_id."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_of = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    pick = [one.where((F.col("toxic") == v) & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_of.get(v, 0) // n)))) == 0)).limit(2 * n)
            for v, n in ((1, positive), (0, negative))]
    sample = F.broadcast(pick[0].unionByName(pick[1]))  # bounded by its two limits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array([parts_of(w) for w in words_of(t)], np.uint16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("lang"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "toxic", "lang", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").join(sample, "doc_id")
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "lang", "text").mapInArrow(
        hashed, "doc_id long, toxic int, lang string, words binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "lang", "words")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()


# --- the network -------------------------------------------------------------

def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of several documents one after the other, two empty places
    after each (row -1): rows, places that are words, first place of each."""
    gap = max(FILTERS) - 1
    first = np.cumsum([0] + [max(1, len(d)) + gap for d in docs])
    rows = np.full((first[-1], *docs[0].shape[1:]), -1, np.int32)
    real = np.zeros(first[-1], bool)
    for d, at in zip(docs, first):
        rows[at:at + len(d)] = d
        real[at:at + max(1, len(d))] = True
    return rows, real, first[:-1]


class Network:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        self.emb = g.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.emb[-1] = 0  # empty places
        self.conv = {k: (g.normal(0, 0.5, (k, DIM, f)) / np.sqrt(k)).astype(np.float32) for k, f in FILTERS.items()}
        self.bias = {k: np.zeros(f, np.float32) for k, f in FILTERS.items()}
        self.out = {k: g.normal(0, 0.3, f).astype(np.float32) for k, f in FILTERS.items()}
        self.shift = np.zeros(1, np.float32)
        self.emb_seen = np.full(DIM, 1e-6, np.float32)
        self.seen = {name: np.full(w.shape, 1e-6, np.float32) for name, w in self._weights().items()}
        #: steps that moved each embedding since ``met`` was last cleared
        self.met = np.zeros(BUCKETS + 1, np.float32)

    def _weights(self) -> dict[str, np.ndarray]:
        """All weights but the embeddings."""
        each = {f"{name}{k}": w[k] for name, w in (("conv", self.conv), ("bias", self.bias), ("out", self.out)) for k in FILTERS}
        return each | {"shift": self.shift}

    def _dense(self) -> list[np.ndarray]:
        return [*self._weights().values(), *self.seen.values(), self.emb_seen]

    def dense(self) -> np.ndarray:
        """All but the embeddings, one after the other."""
        return np.concatenate([w.ravel() for w in self._dense()], dtype=np.float32)

    def set_dense(self, flat: np.ndarray) -> None:
        at = 0
        for w in self._dense():
            w[...] = flat[at:at + w.size].reshape(w.shape)
            at += w.size

    def _update(self, name: str, w: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad."""
        s = self.seen[name]
        s += grad * grad
        w -= RATE * grad / np.sqrt(s)

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        """One pass forward and back over a batch."""
        rows, real, first = _laid_out(docs)
        x = self.emb[rows].sum(1)
        logit, tape = np.full(len(docs), self.shift[0]), {}
        for k in FILTERS:
            z = self._convolve(x, k)
            z[~real] = -np.inf
            top = np.maximum.reduceat(z, first, axis=0)
            doc = np.searchsorted(first, np.arange(len(z)), side="right") - 1
            at = np.empty(top.shape, np.int64)
            place, col = np.nonzero(z == top[doc])
            at[doc[place], col] = place  # of equal maxima the last
            tape[k] = (top, at)
            logit += np.maximum(top + self.bias[k], 0) @ self.out[k]
        grad = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(docs)).astype(np.float32)
        d_emb_rows, d_emb = [], []
        for k, (top, at) in tape.items():
            act = np.maximum(top + self.bias[k], 0)
            d_act = grad[:, None] * self.out[k] * (act > 0)
            d_conv = np.zeros_like(self.conv[k])
            for j in range(k):
                xs = x[at + j]
                d_conv[j] = np.einsum("df,dfe->ef", d_act, xs)
                d_emb.append(np.einsum("df,ef->dfe", d_act, self.conv[k][j]).reshape(-1, DIM))
                d_emb_rows.append(rows[at + j].reshape(-1, PARTS))
            self._update(f"out{k}", self.out[k], grad @ act)
            self._update(f"bias{k}", self.bias[k], d_act.sum(0))
            self._update(f"conv{k}", self.conv[k], d_conv)
        self._update("shift", self.shift, np.array([grad.sum()], np.float32))
        hit = np.concatenate(d_emb_rows)
        order = np.argsort(hit, axis=None, kind="stable")
        by_row = hit.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], by_row[1:] != by_row[:-1]]))
        touched, total = by_row[first], np.add.reduceat(np.concatenate(d_emb)[order // PARTS], first, axis=0)
        total[touched < 0] = 0
        # one step size for all rows: a word that many documents share moves further than a rare one
        self.emb_seen = self.emb_seen + (total * total).sum(0)
        self.emb[touched] -= EMB_RATE * total / np.sqrt(self.emb_seen)
        self.emb[-1] = 0
        self.met[touched] += 1

    def _convolve(self, x: np.ndarray, k: int) -> np.ndarray:
        n = len(x)
        z = x @ self.conv[k][0]
        for j in range(1, k):
            z[:n - j] += x[j:] @ self.conv[k][j]
        return z

    def table(self) -> np.ndarray:
        """Each embedding times every filter's every place."""
        return np.concatenate([self.emb[:-1] @ self.conv[k][j] for k in FILTERS for j in range(k)], axis=1)

    def head(self) -> tuple[np.ndarray, np.ndarray, float]:
        return np.concatenate(list(self.bias.values())), np.concatenate(list(self.out.values())), float(self.shift[0])


class Scorer:
    """Logits of texts with a task's memory of word rows."""

    def __init__(self, table: np.ndarray, head: tuple):
        self.table, self.head = table, head
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((REMEMBERED + 1, self.table.shape[1]), np.float32)  # the last: empty places

    def _known(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        new = {w for d in docs for w in d if w not in self.at}
        if len(self.at) + len(new) > REMEMBERED:
            self._forget()
            new = {w for d in docs for w in d}
            if len(new) > REMEMBERED:
                return None
        start = len(self.at)
        parts = np.array([parts_of(w) for w in new], np.int64).reshape(-1, PARTS)
        self.rows[start:start + len(new)] = self.table[parts].sum(1)
        self.at.update(zip(new, range(start, start + len(new))))
        at = self.at
        return [np.array([at[w] for w in d], np.int32) for d in docs]

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        known = self._known(docs)
        if known is None:  # one enormous document: not by memory
            rows, real, first = _laid_out([np.array([parts_of(w) for w in d], np.int32).reshape(-1, PARTS) for d in docs])
            x = np.where(rows[:, :1] < 0, np.float32(0), self.table[rows].sum(1))
        else:
            rows, real, first = _laid_out(known)
            x = self.rows[rows]
        bias, out, shift = self.head
        tops, col, n = [], 0, len(x)
        for k, f in FILTERS.items():
            z = x[:, col:col + f].copy()
            for j in range(1, k):
                z[:n - j] += x[j:, col + j * f:col + (j + 1) * f]
            z[~real] = -np.inf
            tops.append(np.maximum.reduceat(z, first, axis=0))
            col += k * f
        # added filter by filter: a matrix product rounds a row by its place and by how many there are
        return np.cumsum(np.maximum(np.concatenate(tops, axis=1) + bias, 0) * out, axis=1)[:, -1] + shift


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the labels with the best F1, midway between the
    documents on its sides."""
    order = np.argsort(-logit, kind="stable")
    z, t = logit[order], y[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    i = int(np.argmax(f1))
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def train(sample: list, steps: int = STEPS, seed: int = SEED) -> dict:
    """A model of rows at hand, without Spark (the queries use ``fitted``,
    which learns from every labelled document): table and head of the
    network, the logit of score 0.7, thresholds by language; or a constant
    without both labels."""
    docs = [np.frombuffer(r["words"], np.uint16).astype(np.int32).reshape(-1, PARTS) for r in sample]
    y = np.array([r["toxic"] for r in sample], int)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0, "by_lang": {}}
    g = np.random.default_rng(seed)
    back = np.array([crc32(f"{r['doc_id']}/fold".encode()) % 5 == 0 for r in sample])
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    pos, neg = (np.flatnonzero((y == v) & ~back) for v in (1, 0))
    net = Network(seed)
    for _ in range(steps):
        pick = np.concatenate([g.choice(pos, BATCH // 2), g.choice(neg, BATCH // 2)])
        net.step([docs[i][g.random(len(docs[i])) >= HIDE] for i in pick], y[pick])
    scorer = Scorer(net.table(), net.head())
    check = np.flatnonzero(back) if back.any() else np.arange(len(y))
    table, logit = np.vstack([scorer.table, np.zeros((1, scorer.table.shape[1]), np.float32)]), []
    for i in check:
        scorer.rows = table[docs[i]].sum(1) if len(docs[i]) else np.zeros((1, table.shape[1]), np.float32)
        logit.append(_logit_of_rows(scorer.rows, net.head()))
    logit = np.array(logit)
    zero = best_cut(logit, y[check])
    langs = np.array([r["lang"] or "" for r in sample])[check]
    by_lang = {}
    for lang in sorted(set(langs) - {""}):
        m = langs == lang
        if m.sum() >= ENOUGH and 0 < y[check][m].sum() < m.sum():
            by_lang[lang] = float(_score(best_cut(logit[m], y[check][m]), zero))
    return {"table": scorer.table, "head": net.head(), "zero": zero, "by_lang": by_lang}


def _logit_of_rows(rows: np.ndarray, head: tuple) -> float:
    gap = max(FILTERS) - 1
    x = np.vstack([rows, np.zeros((gap, rows.shape[1]), np.float32)])
    bias, out, shift = head
    tops, col, n = [], 0, len(rows)
    for k, f in FILTERS.items():
        tops.append(sum(x[j:j + n, col + j * f:col + (j + 1) * f] for j in range(k)).max(0))
        col += k * f
    return float(np.maximum(np.concatenate(tops) + bias, 0) @ out + shift)


def _score(logit, zero: float):
    """Scores rise with the logit; the best cut has CUT."""
    return 1 / (1 + np.exp(-np.clip(np.asarray(logit, float) - zero + np.log(CUT / (1 - CUT)), -30, 30)))


# --- learning from every labelled document -----------------------------------

class Learner:
    """One task's network and the documents of a part, as they come."""

    def __init__(self, net: Network, part: int, times: int, ones: int, zeros: int, seed: int):
        self.net, self.part, self.times = copy.deepcopy(net), part, times
        self.net.met[:] = 0
        self.g = np.random.default_rng([seed, part])
        self.rare = int(ones < zeros)
        rare, others = min(ones, zeros), max(ones, zeros)
        #: documents of the rarer label come so often that they are a quarter of all; both labels weigh the same
        self.again = max(1.0, others / 3 / rare)
        share = rare * self.again / (rare * self.again + others)
        self.weight = 0.5 / np.where(np.arange(2) == self.rare, share, 1 - share)
        self.learnt = 0
        self._forget()
        self.docs, self.y, self.held = [], [], 0

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.parts = np.zeros((REMEMBERED, PARTS), np.uint16)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        at = self.at
        new = set(words).difference(at)
        if len(at) + len(new) > REMEMBERED:
            self._forget()
            at, new = self.at, set(words)
            if len(new) > REMEMBERED:  # one enormous document: not by memory
                return np.array([parts_of(w) for w in words], np.uint16)
        for w in new:
            self.parts[len(at)] = parts_of(w)
            at[w] = len(at)
        return self.parts[[at[w] for w in words]].reshape(-1, PARTS)

    def add(self, text: str | None, toxic: int) -> None:
        words = words_of(text)
        self.docs.append(self._rows(words))
        self.y.append(toxic)
        self.held += len(words)
        if self.held >= HELD:
            self.run()

    def run(self) -> None:
        """Learn from the documents that are held."""
        y = np.array(self.y, int)
        few = np.flatnonzero(y == self.rare)
        for _ in range(self.times if len(y) else 0):
            more = np.floor(self.again + self.g.random(len(few))).astype(int)
            order = self.g.permutation(np.concatenate([np.flatnonzero(y != self.rare), np.repeat(few, more)]))
            batch, words = [], 0
            for i in order:
                doc = self.docs[i]
                batch.append((i, doc[self.g.random(len(doc)) >= HIDE].astype(np.int32)))
                words += len(batch[-1][1])
                if len(batch) == BATCH or words >= STEP_WORDS:
                    self._step(batch, y)
                    batch, words = [], 0
            if batch:
                self._step(batch, y)
        self.learnt += len(y)
        self.docs, self.y, self.held = [], [], 0

    def _step(self, batch: list, y: np.ndarray) -> None:
        of = y[[i for i, _ in batch]]
        self.net.step([doc for _, doc in batch], of, self.weight[of])

    def told(self) -> pa.RecordBatch:
        """What was learnt: chunks of embeddings that were met, each with the
        steps that met it, and (chunk -1) all else."""
        self.run()
        met = self.net.met.copy()
        met[-1] = 0  # empty places
        rows = [(-1, b"", np.array([self.learnt], np.float32).tobytes(), self.net.dense().tobytes())]
        for lo in range(0, BUCKETS, CHUNK):
            at = np.flatnonzero(met[lo:lo + CHUNK])
            if len(at):
                rows.append((lo // CHUNK, at.astype(np.int32).tobytes(), met[lo + at].tobytes(), self.net.emb[lo + at].tobytes()))
        chunk, at, weight, value = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([self.part] * len(rows), pa.int64()), pa.array(chunk, pa.int32()),
                                           *[pa.array(c, pa.binary()) for c in (at, weight, value)]], names=["part", "chunk", "at", "weight", "value"])


LEARNT = "part long, chunk int, at binary, weight binary, value binary"


def _learnt(batches: Iterator[pa.RecordBatch], begin) -> Iterator[pa.RecordBatch]:
    """Rows (part, toxic, text) sorted by part: one network per part."""
    now = None
    for b in batches:
        for part, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if now is None or now.part != part:
                if now is not None:
                    yield now.told()
                now = begin(part)
            now.add(text.as_py(), toxic)
    if now is not None:
        yield now.told()


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts' rows of each chunk put together, weighted."""
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for chunk, at, weight, value in zip(*[b.column(c).to_pylist() for c in ("chunk", "at", "weight", "value")]):
            weight, value = np.frombuffer(weight, np.float32).astype(float), np.frombuffer(value, np.float32).astype(float)
            if chunk < 0:
                at, value = np.zeros(1, int), value[None]
            else:
                at, value = np.frombuffer(at, np.int32), value.reshape(-1, DIM)
            total, times = sums.setdefault(chunk, [np.zeros((1 if chunk < 0 else CHUNK, value.shape[1])), np.zeros(1 if chunk < 0 else CHUNK)])
            total[at] += value * weight[:, None]
            times[at] += weight
    for chunk, (total, times) in sums.items():
        at = np.flatnonzero(times)
        mean = (total[at] / times[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([chunk], pa.int32()),
                                          *[pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), times[at].astype(np.float32), mean)]],
                                         names=["part", "chunk", "at", "weight", "value"])


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.concat(doc_id.cast("string"), F.lit("/fold"))) % FOLDS).cast("int")


def labelled(docs: DataFrame, one: DataFrame, parts: int) -> DataFrame:
    """part, toxic, text of the documents with a label in ``one`` (one row
    per doc_id), each part together and in a fixed order.  Labels and texts
    meet in the one exchange that deals the parts."""
    rows = docs.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(True).alias("doc"), "text").unionByName(
        one.select("doc_id", "toxic", F.lit(False).alias("doc"), F.lit(None).cast("string").alias("text")))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(parts).cast("long")).cast("int"))
    same = Window.partitionBy("part", "h", "doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.repartitionById(parts, "part").withColumn("toxic", F.max("toxic").over(same)).where("doc and toxic is not null").select(
        "part", "toxic", "text")


def _round(net: Network, docs: DataFrame, one: DataFrame, ones: int, zeros: int, n: int, seed: int) -> int:
    """One round of learning from the ``n`` labelled rows of ``docs``;
    how many the tasks met."""
    times = max(1, -(-MEETINGS // (ones + zeros)))
    begin = lambda part: Learner(net, part, times, ones, zeros, seed)
    told = labelled(docs, one, max(1, -(-n // PART))).mapInArrow(lambda it: _learnt(it, begin), LEARNT)
    means = told.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_averaged, LEARNT).collect()  # one network
    met = 0
    for r in means:
        value = np.frombuffer(r["value"], np.float32)
        if r["chunk"] < 0:
            net.set_dense(value)
            met = int(np.frombuffer(r["weight"], np.float32)[0])
        else:
            net.emb[r["chunk"] * CHUNK + np.frombuffer(r["at"], np.int32)] = value.reshape(-1, DIM)
    return met


def best_cuts(rows: DataFrame) -> DataFrame:
    """lang, n, ones, cut of rows (lang, toxic, logit): the logit that parts
    each language's labels with the best F1, of all between bins of 1 / BINS."""
    step = F.floor(F.greatest(F.least(F.col("logit"), F.lit(100.0)), F.lit(-100.0)) * BINS)
    bins = rows.groupBy("lang", step.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones"), F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    every = Window.partitionBy("lang")
    down = every.orderBy(F.desc("bin"))
    f1 = 2 * F.sum("ones").over(down) / (F.sum("n").over(down) + F.sum("ones").over(every))
    at = F.coalesce((F.col("lo") + F.lead("hi").over(down)) / 2, F.col("lo") - 1)
    return bins.select("lang", "bin", "n", "ones", f1.alias("f1"), at.alias("at")).groupBy("lang").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.max_by("at", F.struct("f1", "bin")).alias("cut"))


def train_all(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> dict:
    """The model of every document with a label: table and head of the
    network, the logit of score 0.7, thresholds by language, and how many
    documents it learnt from and was checked on; or a constant without both
    labels."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id is not null")
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    of = fold(F.col("doc_id")).alias("fold")
    n = {(r["fold"], r["toxic"]): r["count"] for r in docs.select("doc_id").join(one, "doc_id").groupBy(of, "toxic").count().collect()}
    count = lambda folds, toxic: sum(n.get((f, toxic), 0) for f in folds)
    every = list(range(FOLDS))
    if not count(every, 0) or not count(every, 1):
        return {"constant": count(every, 1) / max(1, sum(n.values())), "by_lang": {}}
    back, learn = every[:1], every[1:]
    if not all(count(f, v) for f in (back, learn) for v in (0, 1)):
        back = learn = every
    zeros, ones = count(learn, 0), count(learn, 1)
    net, met = Network(seed), 0
    for folds in [learn] if zeros + ones <= PART else [[f] for f in learn]:
        here = F.col("doc_id").isNotNull() & fold(F.col("doc_id")).isin(folds)
        if count(folds, 0) + count(folds, 1):
            met += _round(net, docs.where(here), one.where(here), ones, zeros, count(folds, 0) + count(folds, 1), seed + folds[0])
    model = {"table": net.table(), "head": net.head()}
    checked = docs.where(fold(F.col("doc_id")).isin(back)).where(~held_out(F.col("doc_id")))
    logits = scored(checked, model, ["doc_id", "lang"], "logit", raw=True).join(one, "doc_id").select(
        F.coalesce("lang", F.lit("")).alias("lang"), "toxic", "logit")
    logits = cut(logits)
    whole = best_cuts(logits.withColumn("lang", F.lit(""))).first()
    known = f"lang <> '' and n >= {ENOUGH} and ones > 0 and ones < n"
    by_lang = {r["lang"]: float(_score(r["cut"], whole["cut"])) for r in best_cuts(logits).where(known).orderBy("lang").collect()}
    return model | {"zero": whole["cut"], "by_lang": by_lang, "learnt": met, "checked": whole["n"]}


# --- scoring -----------------------------------------------------------------

def _scored(batches: Iterator[pa.RecordBatch], model: dict, text: str, keep: list[str], raw: bool) -> Iterator[pa.RecordBatch]:
    scorer = None if "constant" in model else Scorer(model["table"], model["head"])
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            docs, words = [], 0
            while at + len(docs) < whole.num_rows and words < 25_000:
                docs.append(words_of(whole.column(text)[at + len(docs)].as_py()))
                words += len(docs[-1])
            b = whole.slice(at, len(docs))
            at += len(docs)
            if scorer is None:
                score = np.full(len(docs), model["constant"])
            else:
                score = scorer.logits(docs)
                score = score.astype(float) if raw else _score(score, model["zero"])
            out = [b.column(c) for c in keep] + [pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])


def scored(docs: DataFrame, model: dict, keep: list[str], name: str = "score", raw: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score (``raw``: the logit)
    of its text."""
    sent = keep + [c for c in ("text",) if c not in keep]  # the text goes along once
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sent)]
    text, names = f"k{sent.index('text')}", [f"k{i}" for i in range(len(keep))]
    fields = [docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return docs.select(*cols).mapInArrow(lambda it: _scored(it, model, text, names, raw), inner).toDF(*[f.name for f in fields])


def threshold(lang: Column, model: dict) -> Column:
    """The calibrated threshold of a language."""
    if not model["by_lang"]:
        return F.lit(CUT)
    known = F.create_map(*[F.lit(x) for pair in model["by_lang"].items() for x in pair])
    return F.coalesce(F.try_element_at(known, lang.cast("string")), F.lit(CUT))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from all labelled rows that are not held out."""
    return train_all(docs, labels.where(~held_out(F.col("doc_id"))))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches their language's
    threshold, all columns kept."""
    model, name = fitted(docs, labels), "__toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, docs.columns, name).where(F.col(name) < threshold(F.col("lang"), model)).drop(name)


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, ["doc_id", "lang"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"),
                      (F.col("score") >= threshold(F.col("lang"), model)).alias("rejected"))
