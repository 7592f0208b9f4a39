"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pandas as pd
import pytest

import __spark_entry__ as E
from outagekit.llm import spelling

from .conftest import SF


def brute_words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_near(words):
    """By what is left when one code point of either word goes."""
    at = collections.defaultdict(set)
    for w in words:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            at[x].add(w)
    near = collections.defaultdict(set)
    for group in at.values():
        for a in group:
            near[a] |= {b for b in group if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    return near


def brute(rows):
    words = brute_words(rows)
    near, out, form = brute_near(words), set(), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def told(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = brute(zip(docs.doc_id.tolist(), docs.text))
    got = told(E.queries()["op13_pivotal_grams"](spark, SF))
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[4] for r in want)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = told(spelling.variant_groups(odd_docs))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert told(spelling.variant_groups(no_docs)) == []
    assert told(spelling.variant_groups(odd_docs.where("text is null"))) == []


def test_chains_ties_accents_and_long_runs(spark):
    say = [("aaaaaa", 3), ("aaaaab", 6), ("aaaabb", 12), ("aaabbb", 48), ("äöüßÀ", 4), ("äöüßà", 9), ("äöüßb", 9), ("y" * 3000, 3),
           ("y" * 3001, 7), ("zzzzz", 5), ("zzzzy", 5), ("qwertyu", 3), ("wqertyu", 3), ("ababababab", 3), ("abababababa", 6)]
    text = " ".join(w for w, n in say for _ in range(n))
    docs = spark.createDataFrame([(1, text + " AAAAAA"), (2, None)], "doc_id long, text string")
    got = set(told(spelling.variant_groups(docs)))
    assert got == brute([(1, text + " AAAAAA")])
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][2] in ("aaabbb", "aaaaaa", "aaaabb") and by["äöüßÀ"][1] == "äöüßb"


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_every_near_pair_of_small_alphabets_is_found(spark, letters):
    r = random.Random(7)
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(400)}
    df = spark.createDataFrame([(w, 3) for w in words], spelling.COUNTED)
    got = {(p.word, p.other) for p in spelling.near_pairs(df).collect()}
    assert got == {(a, b) for a, bs in brute_near(words).items() for b in bs}


def test_pivots_are_the_cheapest_two_apart():
    order = {g: k for k, g in enumerate(["ab", "bc", "cd", "de", "ef"])}
    prefix, left, right, last = spelling.pivotal("abcdef", order)
    assert (prefix, left, right, last) == ([0, 1, 2], 0, 2, 2)
