"""Odd rows, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from outagekit.llm import (
    bpe_dropout, exact_dedup, line_chunks, mixing, pfp, secret_scan, simhash, topk, toxicity, url_reputation,
)

from .conftest import odd_texts
from .test_brute import brute_components, brute_fingerprint, brute_removed


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    texts = [(r.doc_id, low(r.text)) for r in odd_docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    keep = {sha(t): max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert len(rows) == len(texts)
    assert collections.Counter((r.doc_id, r.digest) for r in rows) == collections.Counter((i, sha(t)) for i, t in texts)
    assert all(r.keep_id == keep[r.digest] for r in rows)
    assert collections.Counter(r.digest for r in rows if r.kept) == {sha(t): 1 for t in groups}
    assert {r.digest: r.group_size for r in rows} == {sha(t): len(g) for t, g in groups.items()}
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_compares_bytes_when_digests_collide(odd_docs):
    weak = exact_dedup.exact_dedup(odd_docs, digest=lambda c: (F.crc32(c) % 3).cast("string")).collect()
    right = exact_dedup.exact_dedup(odd_docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept)
    assert collections.Counter(map(key, weak)) == collections.Counter(map(key, right))


def test_exact_dedup_state_goes_on(spark, odd_docs, tmp_path):
    staged, state = str(tmp_path / "staged"), str(tmp_path / "state")
    docs = exact_dedup.located(odd_docs.select("doc_id", "text"))
    for part in (docs.where("doc_id < 10"), docs.where("doc_id >= 10 or doc_id is null")):
        rows = exact_dedup.stage_digests(part, staged)
        out = exact_dedup.update_state(spark, rows, staged, state)
    assert out.agg(F.sum("n")).first()[0] == odd_docs.count()
    assert out.where("n > 1").count() > 0


def test_drop_copies_keeps_all_columns(odd_docs):
    out = exact_dedup.drop_copies(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == len({low(r.text) for r in odd_docs.collect()})


def test_near_duplicates(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    docs = odd_docs.collect()
    assert len(rows) == len(docs)
    fps = [brute_fingerprint(r.text) for r in docs]
    want = brute_components([r.doc_id for r in docs], fps)
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows) == collections.Counter(want)
    per = collections.Counter((r.component_id if r.component_id is not None else r.fp) for r in rows if r.kept)
    assert set(per.values()) == {1}
    assert simhash.near_duplicates(no_docs).count() == 0
    left = simhash.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == sum(per.values())


def test_mix(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r["size"] for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    assert all(r.source_size == sizes[r.source] and r.target <= 2 * r.source_size + 1e-6 for r in rows)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.copies for r in rows)
    again = mixing.mix(odd_docs).collect()
    assert collections.Counter(map(tuple, (r[:7] for r in rows))) == collections.Counter(map(tuple, (r[:7] for r in again)))


def test_bpe(odd_docs, no_docs):
    out = bpe_dropout.encoded(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "n_ids", "lossless"]
    rows = out.collect()
    assert all((r.ids is None) == (r.text is None) and r.lossless in ((None,) if r.text is None else (True,)) for r in rows)
    back = bpe_dropout.decoded(out)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r.doc_id, r.text) for r in rows)
    assert bpe_dropout.encoded(no_docs).count() == 0


def test_repeats(odd_docs, no_docs):
    rows = pfp.remove_repeats(odd_docs, with_bytes=True).collect()
    docs = odd_docs.collect()
    want = brute_removed([r.text for r in docs])
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows)
    assert got == collections.Counter((d.doc_id, *w) for d, w in zip(docs, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert pfp.remove_repeats(no_docs).count() == 0


def test_line_chunks(odd_docs, no_docs):
    rows = line_chunks.remove_repeated_chunks(odd_docs, min_lines=1).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.text is None) == (r.n_lines == 0) for r in rows)
    # each distinct one-chunk text stays once
    texts = [r.text for r in odd_docs.collect()]
    assert sum(r.text == "one" for r in rows) == 1 and texts.count("one") == 2
    weak = line_chunks.remove_repeated_chunks(odd_docs, min_lines=1, key=lambda c: F.crc32(c) % 2).collect()
    told = lambda rs: collections.Counter((r.doc_id, r.n_chunks, r.n_removed, r.text) for r in rs)
    assert told(weak) == told(rows)  # chunks that share a key are told apart by their bytes
    assert line_chunks.remove_repeated_chunks(no_docs).count() == 0


def test_secrets(spark, odd_docs, no_docs):
    key = "AKIA" + "ABCD1234EFGH5678"
    more = spark.createDataFrame([(1, f"the key {key}, and password=9f8a7b6c5d4e3f2a11 here"), (2, f"key {key}"), (2, f"key {key}"),
                                  (3, "an incomprehensibilities word"), (None, None)], "doc_id long, text string")
    rows = secret_scan.scan(more).collect()
    assert collections.Counter((r.doc_id, r.is_secret) for r in rows) == {(1, True): 2, (2, True): 2, (3, False): 1}

    secret_scan.scan(odd_docs).collect()
    assert secret_scan.scan(no_docs).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, int(i in (5, 6, 7))) for i in range(20)] + [(3, 1, None), (None, 0, 1), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.labelled_sample(odd_docs, labels), steps=60)
    rows = toxicity.scored(odd_docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.scored(no_docs, model, ["doc_id"]).count() == 0
    none = toxicity.train([])
    assert {r.score for r in toxicity.scored(odd_docs, none, ["doc_id"]).collect()} == {0.0}
    out = toxicity.drop_toxic(odd_docs, labels.limit(0))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_toxicity_of_a_text_alone_and_among_others():
    net = toxicity.Network()
    docs = [toxicity.words_of(t) for t in odd_texts()]
    together = toxicity.Scorer(net.table(), net.head()).logits(docs)
    alone = [toxicity.Scorer(net.table(), net.head()).logits([d])[0] for d in docs]
    assert together.tolist() == [float(z) for z in alone]
    assert together.dtype == alone[0].dtype == "float32"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://User@A.Example.ORG:80/en/1?x", "x://example.org", "x://example.org/", "x://example.org/es/",
            "x://sub.example.org/es/a#b", "x://example.org/en/12", "x://notexample.org/es/", "x://a.com/fr/", "x://b.com/de/x", "x://b.com/de", "x://org/",
            "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, None, "h", "r"), (None, "x://a.org/", "h", "r")],
                                  "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([(11, 1), (11, 1), (12, 0), (99, 1), (None, 1), (5, None)], "page_id long, bad long")
    rows = {(r.page_id, r.host, r.path, r.rule) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert {(4, "user@a.example.org:80", "/en/1", None), (5, "example.org", "", None), (6, "example.org", "/", "org/"),
            (7, "example.org", "/es/", "example.org/es/"), (8, "sub.example.org", "/es/a", "example.org/es/"),
            (9, "example.org", "/en/12", "example.org/en/1"), (10, "notexample.org", "/es/", "org/"), (11, "a.com", "/fr/", "com/fr/"),
            (12, "b.com", "/de/x", "com/de/"), (13, "b.com", "/de", None), (14, "org", "/", "org/"), (15, "b:", "//c/d", None),
            (0, "", "", None), (3, "", "", None), (None, "a.org", "/", "org/")} <= rows
    assert url_reputation.judge_urls(pages, outcomes).count() == pages.count()
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0)).count() == 0


def test_a_bad_record_blocks_a_host_and_one_bad_page_does_not(spark):
    urls = [(i, "x://spam.com/") for i in range(40)] + [(i, "x://fine.com/") for i in range(40, 80)] + [(80, "x://new.com/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, int(i == 40)) for i in range(40, 80)], "page_id long, bad long")
    v = {r.host: r.verdict for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert v == {"spam.com": "block", "fine.com": "allow", "new.com": "allow"}


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (50, []), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (None, [1.0, 1.0]), (7, [0.001, -0.001]), (8, [2.0])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_k(v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 131072), (0, 2, 1, 16384), (0, 3, 2, 16384), (0, 4, 7, 128), (0, 5, 50, 0),
                   (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0), (50, 4, 7, 0), (50, 5, 8, 0)]
    assert topk.top_k(v.limit(0)).count() == 0
