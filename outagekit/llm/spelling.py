"""Spelling variants by pivotal grams (operator 13).

Words are counted over all texts; two are near if one inserted, deleted or
replaced code point turns one into the other.  Near words are found by
pivotal grams.  Bigrams have one order, rare ones first.  A word's *prefix*
is its three first bigrams in that order (with all that equal the third);
its *pivots* are two of the three that do not overlap, chosen by dynamic
programming so that their counts are least.  One edit harms at most one
of the pivots.  Of two near words, let r be the one whose prefix ends no
later in the order: the pivot that the edit leaves alone stands in s too, and
in the prefix of s, so r's pivots look up the prefix grams of s.

Positions limit the look-up.  If the edit lies behind the first pivot, all up
to that pivot's end is the same in both words; if not, all from the second
pivot on is.  What lies on the far side differs by the edit alone, so either
its first half is the same or its last (cut at the middle of the shorter
word's).  A look-up key is the pivot with the near side, the length and
that half; what meets is verified by edit distance.  Groups that meet share
more than half of their code points, so a bigram that many words hold does
not make a large one.

Runs are counted per task before the shuffle and looked-up pairs are
verified where they meet.  Roots are found from the last forms downwards, one
join per step of the longest chain; n doubles with every step, so there are
at most log2 of the largest n.

Defined results: null and empty texts have no words; a null doc_id counts
as the empty text in the checksum; repeated rows count as further
occurrences; very long runs are words like any other; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import cut, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
COUNTED = "word string, n long"
GRAMS = "probe boolean, key long, word string, n long, last int"


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, counts = re.compile(RUN), Counter()

    def told():
        out = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found: Counter = Counter()
            for w, n in Counter(runs.findall(text.as_py() or "")).items():
                found[w.lower() if w.isascii() else w.translate(LOWER)] += n
            mark = b"%d:" % doc_id if doc_id is not None else b":"
            for w, n in found.items():
                h = zlib.crc32(mark + w.encode())
                if h % MISSPELT == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                if len(w) >= LEAST_LENGTH:
                    counts[w] += n
            if len(counts) >= HELD:
                yield told()
    yield told()


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH code points and
    LEAST_COUNT occurrences, one edit of the contract's misspelling applied."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return runs.mapInArrow(_count_runs, COUNTED).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, int]:
    """The rank of each bigram, rarest first.  Words hold 90 code points (26
    letters and U+00C0 to U+00FF), so there are 8,100 bigrams at most."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    grams = words.select("word", at.alias("i")).groupBy(F.col("word").substr(F.col("i"), F.lit(2)).alias("gram")).count()
    return {r.gram: k for k, r in enumerate(sorted(grams.collect(), key=lambda r: (r["count"], r.gram)))}


def pivotal(word: str, order: dict[str, int]) -> tuple[list[int], int, int, int]:
    """(positions of the prefix grams, first pivot, second pivot, rank of the
    prefix's last gram)."""
    ranks = [order[word[i:i + 2]] for i in range(len(word) - 1)]
    first = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))[:3]
    last = ranks[first[-1]]
    # one[p]: the cheapest pivot that ends at or before p; two: the cheapest pair so far
    one: list[tuple[int, int]] = []
    two = None
    for p in sorted(first):
        before = [w for w in one if w[1] + 2 <= p]
        if before and (two is None or min(before)[0] + ranks[p] < two[0]):
            two = (min(before)[0] + ranks[p], min(before)[1], p)
        one.append((ranks[p], p))
    return [i for i, r in enumerate(ranks) if r <= last], two[1], two[2], last


def lookup_keys(word: str, at: int, side: str) -> Iterator[int]:
    """Keys of the gram at ``at``: the gram with all on its ``side`` (L: before
    it, R: behind it), and a half of the rest, for this word as the shorter
    or equal one and as the longer one."""
    near, rest = (word[:at + 2], word[at + 2:]) if side == "L" else (word[at:], word[:at])
    for shorter in (len(word), len(word) - 1):
        k = len(rest) - (len(word) - shorter)
        if k >= 0:
            for half, part in (("a", rest[:k // 2]), ("z", rest[len(rest) - (k - k // 2):])):
                yield xxhash.xxh64_intdigest(f"{side}{half}{shorter} {near} {part}") - (1 << 63)


def _emit_grams(batches: Iterator[pa.RecordBatch], order: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            rows: tuple[list, ...] = ([], [], [], [], [])
            batch = whole.slice(start, 2000)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix, left, right, last = pivotal(word, order)
                keys = [(False, key) for at in prefix for side in "LR" for key in lookup_keys(word, at, side)]
                keys += [(True, key) for at, side in ((left, "L"), (right, "R")) for key in lookup_keys(word, at, side)]
                for probe, key in keys:
                    for column, value in zip(rows, (probe, key, word, n, last)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.bool_()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32())], ["probe", "key", "word", "n", "last"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two near words, in both directions."""
    order = gram_order(words)
    grams = words.mapInArrow(lambda batches: _emit_grams(batches, order), GRAMS)
    r = grams.where("probe").select("key", "word", "n", "last")
    s = grams.where("not probe").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    met = r.join(s, "key").where("word <> other and last <= other_last and abs(length(word) - length(other)) <= 1"
                                 " and levenshtein(word, other, 1) = 1")
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"),
                             F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                      F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return met.select(both.alias("p")).select("p.*").distinct()


def variant_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = cut(counted_words(docs))
    nearest = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = cut(near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), nearest.alias("best"))
               .select("word", "n_near", F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(
                   F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("best")))
    links = near.where("best is not null").select("word", F.col("best.form").alias("form"))
    # words whose form has no form of its own, then those that follow them, and so on
    found = links.join(links.select(F.col("word").alias("form")), "form", "left_anti").select("word", F.col("form").alias("root"))
    roots = found = cut(found)
    while not found.isEmpty():
        found = cut(links.join(found.select(F.col("word").alias("form"), "root"), "form").select("word", "root"))
        roots = roots.unionByName(found)
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form_n").alias("form_n")))


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
