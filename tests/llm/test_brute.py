"""Operators that SQL cannot express, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from outagekit.llm import bpe_dropout, mixing, pfp, simhash, toxicity
from outagekit.llm.common import fresh_dir

from .conftest import SF

MASK = (1 << 64) - 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def brute_components(ids, fps, radius=3):
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                top[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    low = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return [(ids[i], fps[i], low[find(i)]) for i in range(len(ids))]


def brute_removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(d, np.uint8)[~gone[:len(d)]])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_simhash(spark, docs):
    want = {i: (f"{f:016x}", c) for i, f, c in brute_components(docs.doc_id.tolist(), [brute_fingerprint(t) for t in docs.text])}
    assert {r[0]: (r[1], r[2]) for r in E.queries()["op7_simhash_vp"](spark, SF).collect()} == want


def test_shard_trees_find_every_near_pair(spark, monkeypatch):
    g = np.random.default_rng(0)
    base = g.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base[:150] for x, y in g.integers(0, 64, (3, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    monkeypatch.setattr(simhash, "SHARD", 32)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.v & MASK: r.root for r in simhash.components(simhash.near_edges(df, len(fps)), len(fps)).collect()}
    want = brute_components(list(range(len(fps))), [int(x) for x in fps])
    got = collections.defaultdict(set)
    for i, f, _ in want:
        got[roots.get(f, ("alone", f))].add(i)
    by = collections.defaultdict(set)
    for i, _, c in want:
        by[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_repeats(spark, docs):
    rows = {r.doc_id: tuple(r[1:]) for r in E.queries()["op2_pfp_repeats"](spark, SF).collect()}
    assert [rows[i] for i in docs.doc_id] == brute_removed(docs.text)


def test_repeats_of_hot_keys_by_digest(spark, odd_docs):
    a = pfp.remove_repeats(odd_docs.select("doc_id", "text"), hot=1).drop("spans").collect()
    b = pfp.remove_repeats(odd_docs.select("doc_id", "text")).drop("spans").collect()
    assert collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_mix_meets_targets(spark, docs):
    rows = E.queries()["op1_cube_mix"](spark, SF).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (rows["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows.text]).all()
    sizes = rows.groupby("source")["size"].sum()
    order = sorted(sizes.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sizes.sum()
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert rows.groupby("source").target.first().to_dict() == pytest.approx(target)
    taken = rows.groupby("source").taken.sum()
    assert all(abs(taken[s] - target[s]) <= max(20, 0.02 * target[s]) for s in order)
    assert (rows.taken <= 2 * rows["size"]).all()


def test_flight_keeps_both_balances(spark):
    g = np.random.default_rng(2)
    rows = [(i, 0, i, 0, int(s), 0, float(p), 0) for i, (s, p) in enumerate(zip(g.integers(1, 3000, 3000), g.random(3000)))]
    units = spark.createDataFrame(rows, mixing.UNIT)
    for blocks in (1, 7):
        out = mixing.cube_sample(units, blocks).toPandas()
        assert len(out) == len(rows) and set(out.pi) <= {0.0, 1.0}
        assert abs(out.pi.sum() - sum(r[6] for r in rows)) < 8
        assert abs((out.pi * out["size"]).sum() - sum(r[6] * r[4] for r in rows)) < 30


def test_bpe_is_the_vocabularys_own_without_dropout(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=bpe_dropout.MODEL)
    plain = bpe_dropout.Encoder(bpe_dropout.vocabulary(), 0.0)
    for t in [*docs.text[:60], "", " a  b", "\n\t x", "日本 é\U0001F600"]:
        assert plain.encode(t).tolist() == library.encode(t)


def test_bpe_dropout_is_seeded_and_the_agenda_in_bulk_agrees(docs):
    vocab = bpe_dropout.vocabulary()
    one, two, other = (bpe_dropout.Encoder(vocab, seed=s) for s in (1, 1, 2))
    texts = docs.text[:40].tolist()
    a, b, c = ([e.encode(t, i) for i, t in enumerate(texts)] for e in (one, two, other))
    assert all((x == y).all() for x, y in zip(a, b)) and any(len(x) != len(y) for x, y in zip(a, c))
    assert all(one.decode(x) == t for x, t in zip(a, texts))
    words = sorted({w for t in texts for w in one.find(" " + t)})
    keys = [xxhash.xxh64_intdigest(w) for w in words]
    bulk = bpe_dropout.Merges(vocab, 0.2).segment_all(words, keys)
    assert [np.frombuffer(x, np.int32).tolist() for x in bulk] == [bpe_dropout.segment(w, vocab, k, 0.2) for w, k in zip(words, keys)]


def test_toxicity_parts_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = E.queries()["op10_toxicity_cnn"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    rank, pos = held.score.rank(), held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.95
    assert (held.predicted == held.toxic).mean() > 0.96


def test_network_learns_a_word_and_ignores_the_rest():
    g = np.random.default_rng(4)
    rows = []
    for i in range(300):
        words = [b"w%d" % x for x in g.integers(0, 2000, 40)]
        if i % 4 == 0:
            words[int(g.integers(0, 40))] = b"nasty"
        rows.append({"doc_id": i, "toxic": int(i % 4 == 0), "lang": "en", "words": np.array([toxicity.parts_of(w) for w in words], np.uint16).tobytes()})
    model = toxicity.train(rows, steps=200)
    scorer = toxicity.Scorer(model["table"], model["head"])
    fresh = [[b"w%d" % x for x in g.integers(2000, 4000, 40)] for _ in range(50)]
    clean = scorer.logits(fresh)
    bad = scorer.logits([[*d[:20], b"nasty", *d[20:]] for d in fresh])
    assert (bad > model["zero"]).mean() > 0.9 and (clean < model["zero"]).mean() > 0.9


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        path = fresh_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(last) == counts[-1] and last.lossless.all()


def test_toxicity_learns_from_every_labelled_document(spark):
    """No sample: each labelled document that is not held out is learnt from
    or checked, over several parts and rounds; a word that only a few of
    them show is known afterwards."""
    n = 14_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'en', 'de') as lang", "concat('plain', id % 50, ' words', id % 70,"
                                     " if(id % 5 = 0, concat(' ', crc32(cast(id % 200 as string)), 'nasty'), ' fine')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    used = labels.where(~toxicity.held_out(labels.doc_id)).count()
    assert used > 2 * (toxicity.POSITIVE + toxicity.NEGATIVE)
    model = toxicity.fitted(docs, labels)
    assert (model["learnt"] + model["checked"], set(model["by_lang"])) == (used, {"en", "de"})
    got = toxicity.scored(docs, model, ["doc_id"]).where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert ((got.score >= toxicity.CUT) == (got.doc_id % 5 == 0)).mean() > 0.95


def test_toxicity_parts_lie_in_tasks_of_their_own(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'t' as text").unionByName(spark.range(50).selectExpr("7 as doc_id", "cast(null as string) as text"))
    one = spark.range(0, 600, 2).selectExpr("id as doc_id", "1 as toxic").unionByName(spark.createDataFrame([(7, 0)], "doc_id long, toxic int"))
    rows = toxicity.labelled(docs, one, 3)
    assert str(rows._jdf.queryExecution().executedPlan()).count("Exchange ") == 1
    at = rows.selectExpr("part", "toxic", "spark_partition_id() as task").toPandas()
    assert len(at) == 300 + 51 and (at.toxic == 0).sum() == 51
    assert at.groupby("task").part.nunique().tolist() == [1, 1, 1]


def test_toxicity_cuts_have_the_best_f1(spark):
    g = np.random.default_rng(3)
    y = g.random(500) < 0.2
    logit = np.round(g.normal(0, 1, 500) + 1.5 * y, 1)
    rows = spark.createDataFrame([("en", int(t), float(z)) for t, z in zip(y, logit)], "lang string, toxic int, logit double")
    got = toxicity.best_cuts(rows).first()
    f1 = lambda at: 2 * (y & (logit >= at)).sum() / ((logit >= at).sum() + y.sum())
    assert (got.n, got.ones) == (500, y.sum())
    assert f1(got.cut) == max(f1(at) for at in logit)
