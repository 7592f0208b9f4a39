"""Collocations against a plain count."""

import collections
import re

import numpy as np
import pytest

from outagekit.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {c: a for c, a in f.items() if len(c[1]) > 1 and a >= 30}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 80 * f[lang, w[i:i + k]]:
                    gone.add((lang, w[i:i + k]))
    ranked = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            ranked[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rs in ranked.items()
            for i, (s, a, p, x, y) in enumerate(sorted(rs)[:2000])}


def told(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.fixture
def talk(spark):
    a = "New York is big. new\tyork City hall, a b c d e a b c d; x\x0by x\x0cy\r"
    rows = [("en", " ".join([a] * 20)), ("en", a.upper()), (None, " ".join([a] * 31)), ("und", "a b " * 40), ("de", "das ist das ist " * 31),
            ("de", "é ñ É Ñ é ñ É Ñ\x00 " * 31), ("fr", ""), ("fr", None), ("xx", ".,;:!?"), ("xx", "one")]
    rows += [(f"l{i}", "a a a a a " * 30) for i in range(60)] + [("en", " ".join([a] * 20))]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, prefix string, n int")


def test_plain_count(spark, talk):
    got, want = told(collocations.collocations(talk)), brute([(r.lang, r.text) for r in talk.collect()])
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_heavy_prefixes_small_blocks_and_false_bits(talk, monkeypatch):
    """Split stripes, many blocks and a bitmap that says yes to all give the
    same phrases."""
    want = brute([(r.lang, r.text) for r in talk.collect()])
    monkeypatch.setattr(collocations, "HEAVY", 5)
    monkeypatch.setattr(collocations, "BLOCK", 100)
    assert set(told(collocations.collocations(talk))) == want
    monkeypatch.setattr(collocations, "HEAVY", 1_000_000)
    monkeypatch.setattr(collocations, "bitmap", lambda df, at: b"\xff" * (collocations.BITS // 8))
    assert set(told(collocations.collocations(talk))) == want


def test_odd_rows(odd_docs, no_docs):
    got = told(collocations.collocations(odd_docs))
    assert set(got) == brute([(r.lang, r.text) for r in odd_docs.collect()]) and len(got) == len(set(got))
    assert told(collocations.collocations(no_docs)) == []
    assert told(collocations.collocations(odd_docs.where("text is null"))) == []


def test_products_past_64_bits(spark, monkeypatch):
    big = 9 * 10**15
    stripes = spark.createDataFrame([("en", "a", -1, big + 7, [("b", big)]), ("en", "b", -1, big + 9, [])],
                                    "lang string, prefix string, part int, total long, entries array<struct<next:string,n:long>>")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 9)], "lang string, word string, n long")
    monkeypatch.setattr(collocations, "counted_stripes", lambda docs: (words, stripes))
    assert told(collocations.collocations(None)) == [("en", 1, "a b", big, big + 7, big + 9, 2 * big + 16, 2_000_000 * big // (2 * big + 16))]


def test_only_words_that_count_are_shuffled():
    """Ends of pieces and words that the level below leaves out take no room
    in a stripe, and a prefix without any other takes no row."""
    block = collocations.Block([("en", b"a b c. a b d. a b. c a")])
    a, b, c = block.word_spot[0], block.word_spot[1], block.word_spot[2]
    counts = np.isin(block.word_spot, [a, b, c])
    rows = [r for batch in block.stripes(1, counts, np.append(counts[1:], False), {}) for r in batch.to_pylist()]
    assert {r["prefix"]: dict(zip(r["next"].split(" "), r["n"])) for r in rows} == {"a": {"b": 3}, "b": {"c": 1}, "c": {"a": 1}}
