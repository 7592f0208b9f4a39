"""Phrase collocations by stripes (operator 12).

Each prefix of one to three words keys an associative counter of the word
that follows, its *stripe*; ends of pieces and words that cannot matter are
no entries and never shuffled.  A task counts the stripes of its texts, and
stripes of one prefix are merged elementwise after one shuffle.  All that the
scores need comes from the word counts and the merged stripes: an entry is
the count of prefix and word, so the prefix's own count is an entry one level
down, and a phrase that a longer one subsumes is known by the largest entry
of its own stripe (longer by a word behind) and the largest entry that ends
in it (longer by a word before).  A phrase two words longer needs no look: the
phrase between the two occurs at least as often.

Only phrases that occur LEAST times are candidates, and all parts of one
occur at least as often, so the levels run one after the other: words, then
pairs of words that count, three words whose pairs do and four whose triples.
What a level leaves goes to the next as one bitmap of fixed size (BITS) that
has a bit for everything that counts; a false bit adds an entry and changes
no result, since every count is exact.  Prefixes of a two-thousandth of all
words or more (at most 2,000 of them) have their stripes split into parts by
the following word; maxima of the parts are put together again.

Defined results: null and empty texts have no words; null lang is ``und``
(and one with rows whose lang says so); repeated rows count as further
occurrences; one very long text is counted in blocks of whole texts' words;
an empty table gives an empty result; columns but text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagekit.llm.common import cut, table
from outagekit.operators.joins import broadcast_bounded

LEAST, SUBSUMED, LONGEST, FIRST = 30, 80, 4, 2000
SCALE = 2_000_000
#: Bits of the bitmap between the levels (16 MB); a multiple of Spark's 32,768 a bucket.
BITS = 1 << 27
MIXED, LANG_MIXED = 1_000_003, 7_919
#: A prefix with this share of all words is split into PARTS by its next word.
HEAVY, PARTS = 2000, 64
#: Bytes of text that a task counts at once.
BLOCK = 9 << 20
SPACE = pa.scalar(" ", pa.large_string())
#: A stripe on its way: its words go as one text (words hold no blanks).
STRIPES = "lang string, prefix string, part int, next string, n array<int>"


def _cleaning_table() -> bytes:
    """Per byte: A-Z lower-cased, the ends of pieces as line feeds."""
    out = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    for b in b".,;:!?\x0a\x0b\x0c\x0d":
        out[b] = 10
    return bytes(out)


CLEAN = _cleaning_table()


def word_spots(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) % BITS for w in words], np.int64)


def spot(lang: Column, *words: Column) -> Column:
    """The bit of a phrase (the same as in the tasks)."""
    size = F.lit(BITS).cast("long")
    at = lambda c: F.pmod(F.xxhash64(c), size)
    out = at(words[0])
    for w in words[1:]:
        out = F.pmod(out * MIXED + at(w), size)
    return F.pmod(at(lang) * LANG_MIXED + out, size)


class Block:
    """The words of some texts as numbers, with all that counts in them."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        langs = sorted({lang for lang, _ in texts})
        data = np.frombuffer(b"\n".join(t.translate(CLEAN) for _, t in texts) + b"\n", np.uint8)
        gap = (data == 10) | (data == 32) | (data == 9)
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        offsets = np.append(starts - np.cumsum(gap, dtype=np.int32)[starts], len(data) - gap.sum()).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(data == 10, dtype=np.int32)[starts]
        ends = np.cumsum([len(t) + 1 for _, t in texts])
        where = {lang: k for k, lang in enumerate(langs)}
        number = np.array([where[lang] for lang, _ in texts])
        self.langs, self.lang = langs, number[np.searchsorted(ends, starts, "right")]
        n = len(starts)
        #: whether the word after each word is in the same piece
        self.joined = np.append(piece[1:] == piece[:-1], False) if n else np.zeros(0, bool)
        spots = word_spots(self.words.to_pylist())
        self.word_spot = spots[self.codes]
        self.lang_spot = word_spots([lang.encode() for lang in langs])[self.lang] * LANG_MIXED
        self.part = spots % PARTS

    def passing(self, bits: np.ndarray, words: int) -> np.ndarray:
        """Whether the bit of so many words from each one on is set."""
        at = self.word_spot
        for k in range(1, words):
            at = (at * MIXED + np.append(self.word_spot[k:], np.zeros(min(k, len(at)), np.int64))) % BITS
        at = (self.lang_spot + at) % BITS
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def named(self, at: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.codes[at])).cast(pa.large_string())

    def stripes(self, level: int, counts: np.ndarray | None, known: np.ndarray | None, heavy: dict) -> Iterator[pa.RecordBatch]:
        """The stripes of prefixes of ``level`` words that start where
        ``counts`` says, without words that ``known`` leaves out."""
        n, v = len(self.codes), len(self.words)
        ok = np.ones(n, bool) if counts is None else counts.copy()
        for k in range(1, level):  # the prefix lies in one piece
            ok[:n - k + 1] &= self.joined[k - 1:]
            ok[max(0, n - k + 1):] = False
        at = np.flatnonzero(ok)
        at = at[self.joined[at + level - 1]]  # a word of the same piece follows
        if known is not None:
            at = at[known[at]]
        if not len(at):
            return
        follows = self.codes[at + level]
        # the prefix as one number: (language, word, word, word), made dense as it grows
        prefix = self.lang[at].astype(np.int64) * v + self.codes[at]
        for k in range(1, level):
            prefix = np.unique(prefix, return_inverse=True)[1] * v + self.codes[at + k]
        dense, first, prefix = np.unique(prefix, return_index=True, return_inverse=True)
        pairs, times = np.unique(prefix * v + follows, return_counts=True)
        prefix, follows = pairs // v, pairs % v
        place = at[first]
        names, two = self.named(place), None
        for k in range(1, level):
            names = pc.binary_join_element_wise(names, self.named(place + k), SPACE)
            two = names if k == 1 else two
        lang = self.lang[place]
        split = np.zeros(len(dense), bool)
        if heavy:
            key = names if two is None else two
            for k, name in enumerate(self.langs):
                if heavy.get(name):
                    split |= (lang == k) & pc.is_in(key, pa.array(heavy[name], pa.large_string())).to_numpy(zero_copy_only=False)
        part = np.where(split[prefix], self.part[follows], -1)
        if split.any():
            order = np.lexsort((part, prefix))
            prefix, follows, times, part = prefix[order], follows[order], times[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]))
        follow_names = self.words.cast(pa.string())
        for lo in range(0, len(edge), 50_000):
            head = edge[lo:lo + 50_000]
            stop = edge[lo + 50_000] if lo + 50_000 < len(edge) else len(prefix)
            offsets = pa.array(np.append(head, stop) - head[0], pa.int32())
            entries = slice(head[0], stop)
            own = pa.array(prefix[head])
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.langs, pa.string()).take(pa.array(lang[prefix[head]])), names.take(own).cast(pa.string()),
                 pa.array(part[head], pa.int32()),
                 pc.binary_join(pa.ListArray.from_arrays(offsets, follow_names.take(pa.array(follows[entries]))), " "),
                 pa.ListArray.from_arrays(offsets, pa.array(times[entries], pa.int32()))],
                ["lang", "prefix", "part", "next", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((lang, text.as_py().encode()))
            size += len(held[-1][1])
            if size >= BLOCK:
                yield Block(held)
                held, size = [], 0
    if held:
        yield Block(held)


def _word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripe of no word at all: how often each word occurs."""
    for b in _blocks(batches):
        v = len(b.words) + 1
        keys, times = np.unique(b.lang.astype(np.int64) * v + b.codes, return_counts=True)
        words, langs = b.words.cast(pa.string()), pa.array(b.langs, pa.string())
        for lo in range(0, len(keys), 50_000):
            k, t = keys[lo:lo + 50_000], times[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(k // v)), words.take(pa.array(k % v)), pa.array(t, pa.int64())],
                                             ["lang", "word", "n"])


def _pair_stripes(batches, bits, heavy) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        counts = b.passing(bits, 1)
        yield from b.stripes(1, counts, np.append(counts[1:], False), heavy)


def _triple_stripes(batches, bits, heavy) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        pair = b.passing(bits, 2) & b.joined
        yield from b.stripes(2, pair, np.append(pair[1:], False), heavy)


def _quad_stripes(batches, bits, heavy) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        triple = b.passing(bits, 3) & b.joined & np.append(b.joined[1:], False)
        yield from b.stripes(3, triple, np.append(triple[1:], False), heavy)


def merged(stripes: DataFrame) -> DataFrame:
    """Stripes of one prefix (and part) merged elementwise: lang, prefix,
    part and ``entries`` {next, n}, those of LEAST or more."""
    dealt = stripes.repartition("lang", "prefix", "part")
    one = dealt.select("lang", "prefix", "part", F.inline(F.arrays_zip(F.split("next", " ").alias("next"), "n")))
    whole = one.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return whole.groupBy("lang", "prefix", "part").agg(F.collect_list(F.struct("next", "n")).alias("entries"))


def bitmap(df: DataFrame, at: Column) -> bytes:
    """BITS bits with the one at ``at`` set for each row of ``df``: always
    BITS / 8 bytes, put together from Spark's buckets of 32,768 (whose
    positions count from 1)."""
    rows = (df.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    out = bytearray(BITS // 8)
    for r in rows.toLocalIterator():
        start = (r.bucket - 1) * 4096
        out[start:start + len(r.bits)] = r.bits
    return bytes(out)


def _heavy(df: DataFrame, phrase: str, total: int) -> dict[str, list[str]]:
    """Phrases with a HEAVYth of all ``total`` words: at most HEAVY rows."""
    out: dict[str, list[str]] = {}
    for r in df.where(F.col("n") >= -(-total // HEAVY)).select("lang", F.col(phrase).alias("phrase")).collect():
        out.setdefault(r.lang, []).append(r.phrase)
    return out


def _shared(spark: SparkSession, bits: bytes, heavy: dict):
    return spark.sparkContext.broadcast((bits, heavy))


def counted_stripes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words {lang, word, n}, stripes {lang, prefix, part, entries}) of a
    corpus: every word, and every prefix with an entry of LEAST or more."""
    spark = docs.sparkSession
    texts = docs.where("text is not null and text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = cut(texts.mapInArrow(_word_stripes, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") >= LEAST)
    one = _shared(spark, bitmap(frequent, spot(F.col("lang"), F.col("word"))), _heavy(words, "word", total))
    pairs = cut(merged(texts.mapInArrow(lambda b: _pair_stripes(b, np.frombuffer(one.value[0], np.uint8), one.value[1]), STRIPES)))
    found = pairs.select("lang", "prefix", F.inline("entries"))
    heavy = _heavy(found.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "n"), "phrase", total)
    two = _shared(spark, bitmap(found, spot(F.col("lang"), F.col("prefix"), F.col("next"))), heavy)
    triples = cut(merged(texts.mapInArrow(lambda b: _triple_stripes(b, np.frombuffer(two.value[0], np.uint8), two.value[1]), STRIPES)))
    found = triples.select("lang", F.split("prefix", " ").alias("p"), F.inline("entries"))
    three = _shared(spark, bitmap(found, spot(F.col("lang"), F.col("p")[0], F.col("p")[1], F.col("next"))), heavy)
    quads = cut(merged(texts.mapInArrow(lambda b: _quad_stripes(b, np.frombuffer(three.value[0], np.uint8), three.value[1]), STRIPES)))
    return words, pairs.unionByName(triples).unionByName(quads)


def _level(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def with_count(rows: DataFrame, key: str, counts: DataFrame, total: int, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``.  Heavy phrases are at
    most LONGEST * HEAVY rows and broadcast, so none of them is a join key."""
    c = counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    is_heavy = F.col(name) >= -(-total // HEAVY)
    few = broadcast_bounded(c.where(is_heavy))
    return (rows.join(few, ["lang", key])
            .unionByName(rows.join(few.select("lang", key), ["lang", key], "left_anti").join(c.where(~is_heavy), ["lang", key])))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's FIRST phrases."""
    words, stripes = counted_stripes(docs)
    size = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = cut(stripes.select("lang", "prefix", F.inline("entries")))
    candidates = entries.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    # parts of a candidate occur as often at least: words, and entries of the levels below
    counts = words.where(F.col("n") >= LEAST).select("lang", F.col("word").alias("phrase"), "n").unionByName(
        candidates.where(_level("phrase") < LONGEST).select("lang", "phrase", F.col("a").alias("n")))
    # the largest entry of the phrase's stripe, and the largest that ends in it
    ends_in = F.concat_ws(" ", F.expr("substring(prefix, instr(prefix, ' ') + 1)"), "next")
    longer = (entries.where(F.instr("prefix", " ") > 0).select("lang", F.explode(F.array(F.col("prefix"), ends_in)).alias("phrase"), "n")
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    left = (candidates.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(30,0)") < SUBSUMED * F.col("a").cast("decimal(30,0)")))
            .select("lang", "phrase", "a"))
    parts = F.split("phrase", " ")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), _level("phrase") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first_part"),
        F.array_join(F.slice(parts, F.col("k") + 1, _level("phrase") - F.col("k")), " ").alias("rest"))
    cuts = with_count(with_count(cuts, "first_part", counts, total, "l"), "rest", counts, total, "r")
    score = F.expr(f"cast((cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r) as bigint)")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST)
    return top.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
      FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c), (SELECT unnest([2, 3]) AS m)
      WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
e AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a),
u AS (SELECT *, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2
      FROM (SELECT *, unnest(range(1, k)) AS j FROM e)),
v AS (SELECT u.lang, u.phrase, u.a, u.j, x.f AS l, y.f AS r, (({SCALE}::HUGEINT * u.a) // (x.f + y.f))::BIGINT AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.p1 JOIN f y ON y.lang = u.lang AND y.phrase = u.p2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= {FIRST}
"""
