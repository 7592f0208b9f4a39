"""Operators do the whole of their job: nothing capped, thinned or refused."""

import numpy as np
import pyarrow as pa
import pytest

from outagekit.llm import bpe_dropout, topk


def test_bpe_draws_for_each_occurrence_of_a_word():
    vocab = bpe_dropout.vocabulary()
    one = bpe_dropout.Encoder(vocab)
    text, long = " ".join(["international"] * 300), "x" * 50 + " é\U0001F600 " + "responsibilities " * 3
    seen = []

    def pieces(ids):
        """Its ids, word by word."""
        out = []
        for i in ids.tolist():
            if vocab["spelled"][i].startswith(b" "):
                out.append([])
            out[-1].append(i)
        return set(map(tuple, out))

    ids = one.encode(text, 1)
    assert one.decode(ids) == text and len(pieces(ids)) > 8
    assert not np.array_equal(one.encode("a " + text, None)[-50:], one.encode("b " + text, None)[-50:])
    for t in (text, long):  # each by its own agenda
        words = one.find(" " + t)
        keys = one._keys([t], [7], [len(words)])
        seen += [int(k) for k in keys]
        assert one.encode(t, 7).tolist() == [i for w, k in zip(words, keys) for i in bpe_dropout.segment(w, vocab, int(k), bpe_dropout.DROPOUT)]
    assert len(set(seen[:300])) == 300
    few = bpe_dropout.Encoder(vocab)  # in a batch with others, and having forgotten words
    old, bpe_dropout.REMEMBERED = bpe_dropout.REMEMBERED, 3
    try:
        for _ in range(2):
            a, b, c = few.encode_all([long, None, text], [7, 8, 1])
            assert b is None and np.array_equal(c, ids) and np.array_equal(a, one.encode(long, 7))
    finally:
        bpe_dropout.REMEMBERED = old


def test_bpe_lossless_is_found_by_decoding(monkeypatch):
    how = (bpe_dropout.vocabulary(), 0.1, 23)
    batch = pa.RecordBatch.from_pydict({"i": [1, 2, 3, 4, 5], "t": ["some words", "", None, " é\U0001F600\x00", "more"]})
    told = lambda: next(bpe_dropout._encode(iter([batch]), ["i", "t"], how)).column(2).to_pylist()
    assert told() == [True, True, None, True, True]
    right = bpe_dropout.Encoder.encode_all

    def wrong(self, texts, docs):
        """Two ids of the first document change places; the last one's are missing."""
        out = right(self, texts, docs)
        return [out[0][::-1].copy(), *out[1:-1], out[-1][:0]]

    monkeypatch.setattr(bpe_dropout.Encoder, "encode_all", wrong)
    assert told() == [False, True, None, True, False]


def brute_top(ids, c, qids, q, k):
    out = []
    for i, row in zip(qids.tolist(), q.tolist()):
        scores = [(-sum(a * b for a, b in zip(row, v)), j) for j, v in zip(ids.tolist(), c.tolist()) if j != i]
        out.append([(j, -s) for s, j in sorted(scores)[:k]])
    return out


def test_top_k_reads_each_query_to_its_own_end(monkeypatch):
    r = np.random.default_rng(3)
    ids = np.arange(640)
    c = 1000 + r.integers(-1, 2, (640, 4))  # nearly equal: bounds meet late
    c[:5] += 5000
    q = np.array([[7, -7, 7, -7], [1, 0, 0, 0], [0, 0, 0, 0]])
    qids = np.array([1000, 1001, 3])
    read = []
    bounds = topk.Lists.bounds
    monkeypatch.setattr(topk.Lists, "bounds", lambda self, depth, up, down: read.append((depth, len(up))) or bounds(self, depth, up, down))
    found = topk.Lists(ids, c, np.float64).best(qids, q, 5)
    assert [list(zip(i.tolist(), s.tolist())) for i, s in found] == brute_top(ids, c, qids, q, 5)
    assert read[0] == (40, 3) and read[1][1] < 3  # a 16th; what needs no more reading is not read on
    assert read[-1][0] > 600 and read[-1][1] == 1  # past 15/16 where the bounds need it


@pytest.mark.parametrize("large, kind", [(50_000 * 256, np.int64), (2_000_000 * 256, object)])
def test_top_k_scores_large_components_exactly(large, kind):
    r = np.random.default_rng(4)
    ids, c = np.arange(60), r.integers(-300, 300, (60, 64))
    c[7] = large + np.arange(64)
    c[8] = -large
    qids, q = ids[[0, 8, 50]], c[[0, 8, 50]].copy()
    q[1] = -9
    q[1, 3] = large - 1
    assert topk.exact_kind(c, q) is kind
    batch = pa.RecordBatch.from_pydict({"ids": [ids.tolist()], "vecs": [c.tolist()], "qids": [qids.tolist()], "qvecs": [q.tolist()]})
    rows = next(topk._search(iter([batch]), 5)).to_pydict()
    got = list(zip(rows["query_id"], rows["vec_id"], rows["score"]))
    assert got == [(i, *t) for i, ts in zip(qids.tolist(), brute_top(ids, c, qids, q, 5)) for t in ts]


def test_top_k_bounds_are_those_of_the_lists():
    r = np.random.default_rng(5)
    c, q = r.integers(-40, 40, (30, 6)), r.integers(-40, 40, (7, 6))
    lists = topk.Lists(np.arange(30), c, np.float32)
    up, down = np.maximum(q, 0).astype(np.float32), np.minimum(q, 0).astype(np.float32)
    for depth in (1, 4, 29):
        low, high = lists.bounds(depth, up, down)
        for i, j in np.ndindex(7, 30):
            least = most = 0
            for d in range(6):
                s = np.sort(c[:, d])
                read = lists.rank[j, d] >= 30 - depth if q[i, d] > 0 else lists.rank[j, d] < depth
                rest = (s[0], s[-depth]) if q[i, d] > 0 else (s[-1], s[depth - 1])
                least += q[i, d] * (c[j, d] if read else rest[0])
                most += q[i, d] * (c[j, d] if read else rest[1])
            assert (low[i, j], high[i, j]) == (least, most) and least <= q[i] @ c[j] <= most


@pytest.mark.parametrize("group, spread", [(2 ** 23, 64), (3 * 40 * 8, 2), (1, 1)])
def test_top_k_never_broadcasts_the_copies_of_its_queries(spark, monkeypatch, group, spread):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "SPREAD", spread)
    grouped = topk.grouped
    monkeypatch.setattr(topk, "grouped", lambda blocks, d, tasks: grouped(blocks, d))
    r = np.random.default_rng(6)
    x = np.round(r.normal(0, 1, (500, 8)), 3)
    x[30:60] = x[30]
    v = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = topk.top_k(v, step=10)
    got = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    ids, q = np.arange(500), np.floor(256 * x).astype(np.int64)
    best = brute_top(ids, q, ids[::10], q[::10], 5)
    assert got == [(i, n, *t) for i, ts in zip(range(0, 500, 10), best) for n, t in enumerate(ts, 1)]


def test_top_k_copies_of_queries_follow_groups_not_blocks():
    assert [topk.grouped(b, 64) for b in (1, 2, 76, 127, 128, 375, 512, 1000, 8000)] == [1, 2, 76, 127, 64, 75, 64, 67, 500]
    assert (topk.grouped(375, 64, 2000), topk.grouped(8000, 512), topk.grouped(375, 10 ** 5), topk.grouped(1, 0)) == (375, 4000, 375, 1)


def test_top_k_sorts_the_lists_of_a_block_once(monkeypatch):
    made, init = [], topk.Lists.__init__
    monkeypatch.setattr(topk.Lists, "__init__", lambda self, ids, c, kind: made.append((len(ids), kind)) or init(self, ids, c, kind))
    r = np.random.default_rng(8)
    a, b, q = (r.integers(-90, 90, (n, 5)) for n in (20, 20, 3))
    ids, qids = list(range(20)), [3, 4, 100]
    wide, large = np.hstack([q, q[:, :1]]), q * 10 ** 5
    pairs = [(a, q), (a, -q), (b, q), (b, large), (b, wide), (a[:, :3], q), (a, q)]  # the same ids, other vectors
    batch = pa.RecordBatch.from_pydict({"ids": [ids] * 7, "vecs": [v.tolist() for v, _ in pairs], "qids": [qids] * 7, "qvecs": [x.tolist() for _, x in pairs]})
    for (v, x), out in zip(pairs, topk._search(iter([batch]), 4), strict=True):
        full = [[*row, 0, 0, 0] for row in v.tolist()]
        best = brute_top(np.array(ids), np.array(full), np.array(qids), x, 4)
        assert list(zip(*(out.column(i).to_pylist() for i in (0, 2, 3)))) == [(i, *t) for i, ts in zip(qids, best) for t in ts]
    assert made == [(20, np.float32), (20, np.float32), (20, np.float64), (20, np.float32), (20, np.float32), (20, np.float32)]
