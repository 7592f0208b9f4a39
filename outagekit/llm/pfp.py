"""Repeated byte strings by prefix-free parsing (operator 2).

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
in the corpus is found.  A rolling hash over ``W`` bytes triggers phrase
boundaries; they depend on those bytes alone, so equal strings are parsed
alike.  The suffixes of a phrase and what follows the phrase (the parse) name
every position of the corpus: the string at ``d`` bytes before a trigger is
the phrase's last ``d`` bytes and the first ``LENGTH - d`` after them.  Two
orders are built - of the dictionary, phrases compared from their ends, and of
the parse, what follows compared from its start - each with the common lengths
of neighbours.  Positions ``d`` bytes before their triggers hold equal strings
exactly if both orders keep them together: no neighbours between them agree on
less than ``d`` bytes in one, or less than ``LENGTH - d`` in the other.

Positions are shared out by the ``CONTEXT`` bytes after their trigger (a
string's first trigger with so many bytes of it left).  A first pass counts
these keys; only those at two or more places are looked at again, so texts
that repeat nothing are never compared.  A string without such a trigger (in
monotonous text) has its first of a second, denser kind instead, and one
without either is its own key.  Keys at over ``HOT`` places are not brought
together in a task: the strings of these positions are counted by a 128-bit
digest, combined before the shuffle.

Equal texts are parsed once; their copies are removed whole (if long enough).
Strings that a text repeats itself are found while it is parsed, and one place
of each kind goes on to be compared with other texts.

Defined results: null counts as empty; texts under ``LENGTH`` bytes lose
nothing; each of repeated rows is a text; an empty table gives an empty
result; other columns are never read.  Two texts with the same 64-bit hash
stop the job with a message (another ``seed`` avoids it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import cut, table

LENGTH = 400
#: Bytes of a trigger; one place in so many is one, and one of the second
#: kind; bytes of a key (a multiple of W).
W, EVERY, DENSE, CONTEXT = 16, 64, 16, 128
#: Places of a key above which it is not gathered; places compared at once.
HOT, GATHER = 50_000, 20_000
BASE = 0x9E3779B97F4A7C15 | 1
SEED = 42
#: Bytes of text hashed at once.
SLAB = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


# --- parsing -----------------------------------------------------------------

def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the W bytes at each place (the last W - 1 are not meant)."""
    g = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
    h, n = g[data], 1
    while n < W:
        h[:len(h) - n] = h[:len(h) - n] * _power(n) + h[n:]
        n *= 2
    return h


def _context(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hash of the CONTEXT bytes at the places ``p``."""
    step, out = _power(W), np.zeros(len(p), np.uint64)
    for k in range(0, CONTEXT, W):
        out = out * step + h[p + k]
    return out


def parsed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(index of a text, places, least, reach, keys, own spans): the strings
    that start ``least`` to ``reach`` bytes before a place are named by it;
    own spans are starts of strings that the text itself repeats."""
    limit = LENGTH - CONTEXT
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLAB):
            size += len(texts[stop])
            stop += 1
        data = np.frombuffer(b"".join(texts[at:stop]) + bytes(CONTEXT), np.uint8)
        h = window_hashes(data)
        draw = h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        hit = np.flatnonzero(draw < np.uint64((1 << 32) // EVERY))
        dense = draw >= np.uint64((1 << 32) - (1 << 32) // DENSE)
        first = np.cumsum([0] + [len(t) for t in texts[at:stop]])
        cuts = np.searchsorted(hit, first)
        for k in range(at, stop):
            lo, n = first[k - at], len(texts[k])
            if n < LENGTH:
                continue
            g = hit[cuts[k - at]:cuts[k - at + 1]] - lo
            g = g[g <= n - W]
            edge = np.concatenate([[-1], g])
            reach = np.minimum(g - edge[:-1] - 1, limit)
            least = np.maximum(g + LENGTH - n, 0)
            ok = least <= reach
            places, lows, highs = [g[ok]], [least[ok]], [reach[ok]]
            lone = []
            after = np.concatenate([g, [n + limit]])
            for j in np.flatnonzero(after - edge > limit + 1):
                a, z = edge[j] + 1, min(after[j] - limit - 1, n - LENGTH)  # starts without an early trigger
                if a > z:
                    continue
                s = a + np.flatnonzero(dense[lo + a:lo + min(z + limit, n - W) + 1])
                before = np.concatenate([[a - 1], s])
                high = np.minimum(s - before[:-1] - 1, limit)
                low = np.maximum(s - z, 0)
                named = low <= high
                places.append(s[named])
                lows.append(low[named])
                highs.append(high[named])
                nxt = np.concatenate([s, [n + LENGTH]])
                for i in np.flatnonzero(nxt - before > limit + 1):
                    lone.append(np.arange(before[i] + 1, min(nxt[i] - limit - 1, z) + 1))
            places, lows, highs = (np.concatenate(x).astype(np.int64) for x in (places, lows, highs))
            keys = _context(h, places + lo)
            if lone:
                own = np.concatenate(lone).astype(np.int64)
                t = texts[k]
                digests = np.array([xxhash.xxh64_intdigest(t[i:i + LENGTH], 7) for i in own.tolist()], np.uint64)
                zero = np.zeros(len(own), np.int64)
                places, lows, highs, keys = (np.concatenate(x) for x in ((places, own), (lows, zero), (highs, zero), (keys, digests)))
            yield k, *_own_repeats(texts[k], places, lows, highs, keys)
        at = stop


def _own_repeats(text: bytes, g: np.ndarray, least: np.ndarray, reach: np.ndarray, keys: np.ndarray) -> tuple:
    """Places whose strings a text repeats itself, byte for byte: their spans
    are known here, and one place of each kind stands for them elsewhere."""
    order = np.argsort(keys, kind="stable")
    twin = keys[order[1:]] == keys[order[:-1]]
    again = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
    if not again.any():
        return g, least, reach, keys, []
    kinds: dict[tuple, list[int]] = {}
    for i in order[again].tolist():
        a, z = g[i] - reach[i], g[i] - least[i]
        kinds.setdefault((int(least[i]), int(reach[i]), text[a:z + LENGTH]), []).append(i)
    same = [m for m in kinds.values() if len(m) > 1]
    spans = [(int(g[i] - reach[i]), int(g[i] - least[i])) for m in same for i in m]
    keep = np.ones(len(g), bool)
    keep[[i for m in same for i in m[1:]]] = False
    return g[keep], least[keep], reach[keep], keys[keep], spans


def unpacked(at):
    """Place, least, reach of a packed place."""
    return at >> 18, at >> 9 & 511, at & 511


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        us = b.column("u").to_numpy(zero_copy_only=False)
        texts = [t.encode("utf-8", "surrogatepass") for t in b.column("t").to_pylist()]
        u, at, key, held = [], [], [], 0
        for k, g, least, reach, keys, _ in parsed(texts):
            u.append(np.full(len(g), us[k]))
            at.append(g << 18 | least << 9 | reach)
            key.append(keys.view(np.int64))
            held += len(g)
            if held > 200_000:
                yield _batch(["key", "u", "at"], [key, u, at])
                u, at, key, held = [], [], [], 0
        if u:
            yield _batch(["key", "u", "at"], [key, u, at])


def _batch(names: list[str], cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=names)


# --- the two orders ----------------------------------------------------------

def _order(keys: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices in (key, string) order and, for each but the first, how many
    bytes it shares with the one before (-1: another key)."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (keys[i], strings[i])))
    rows = np.frombuffer(b"".join([strings[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(len(order), width)
    size = np.array([len(strings[i]) for i in order])
    common = np.zeros(len(order) - 1, np.int64)
    for a in range(0, len(common), 4096):
        part = rows[a:a + 4097]
        off = part[1:] != part[:-1]
        common[a:a + 4096] = np.where(off.any(1), off.argmax(1), width)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[keys[order[1:]] != keys[order[:-1]]] = -1
    return order, common


def repeated_starts(keys: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of a place, start) of the strings that occur more than once
    among the given places (all places of each key)."""
    n = len(keys)
    g, least, reach = unpacked(at)
    dictionary, same_left = _order(keys, [s[::-1] for s in left], max(1, int(reach.max())))
    parse, same_right = _order(keys, right, LENGTH)
    who, start = [], []
    for d in range(int(reach.max()) + 1):
        here = np.flatnonzero((least <= d) & (d <= reach))
        if len(here) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[dictionary] = np.concatenate([[0], np.cumsum(same_left < d)])
        b[parse] = np.concatenate([[0], np.cumsum(same_right < LENGTH - d)])
        name = a[here] * n + b[here]
        order = np.argsort(name, kind="stable")
        name = name[order]
        twin = name[1:] == name[:-1]
        both = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        found = here[order[both]]
        who.append(found)
        start.append(g[found] - d)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(start)


def _runs(u: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in runs: (u, first, last)."""
    order = np.lexsort((start, u))
    u, start = u[order], start[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (start[1:] > start[:-1] + 1)])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(u) - 1]])
    return u[new], start[new], start[ends]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream places sorted by key; whole keys are compared, about GATHER
    places at a time."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            key, u, at, left, right = zip(*rows)
            who, start = repeated_starts(np.array(key), np.array(at), list(left), list(right))
            if len(who):
                cols = _runs(np.array(u)[who], start)
                yield _batch(["u", "first", "last"], [[c] for c in cols])

    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("key", "u", "at", "left", "right")]):
            if len(held) >= GATHER and row[0] != held[-1][0]:
                yield from flush(held)
                held = []
            held.append(row)
    yield from flush(held)


# --- places and their strings --------------------------------------------------

def _strings(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
    """Texts joined with their places: the strings around each place; for
    hot keys (``hot``) the digest of each string instead."""
    for b in batches:
        us, texts, places = (b.column(c).to_pylist() for c in ("u", "t", "places"))
        out: list[tuple] = []
        for u, t, found in zip(us, texts, places):
            data = t.encode("utf-8", "surrogatepass")
            for p in found:
                if p["hot"] != hot:
                    continue
                g, least, reach = unpacked(p["at"])
                if hot:
                    for i in range(g - reach, g - least + 1):
                        out.append((hashlib.blake2b(data[i:i + LENGTH], digest_size=16).digest(), u, i))
                else:
                    out.append((p["key"], u, p["at"], data[g - reach:g], data[g:g + LENGTH]))
                if len(out) > 20_000:
                    yield _rows(out, hot)
                    out = []
        if out:
            yield _rows(out, hot)


def _rows(out: list[tuple], hot: bool) -> pa.RecordBatch:
    cols = list(zip(*out))
    if hot:
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                          names=["digest", "u", "first"])
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "u", "at", "left", "right"])


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(F.lit(seed), t).alias("u"), t.alias("t"))


def _twice(place: Column) -> list[Column]:
    """Aggregates that differ if a group holds two different places."""
    return [F.min(place).alias("lo"), F.max(place).alias("hi")]


def distinct_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """u, t, n: the distinct texts and how many rows have each."""
    v = F.xxhash64(F.lit(seed + 1), "t")
    one = _texts(docs, seed).groupBy("u").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"), F.min(v).alias("v"), F.max(v).alias("w"))
    clash = F.raise_error(F.lit("two texts have the same 64-bit hash: pass another seed"))
    return one.select("u", "t", F.when(F.col("v") == F.col("w"), F.col("n")).otherwise(clash.cast("long")).alias("n"))


def repeated_spans(docs: DataFrame, hot: int = HOT, seed: int = SEED) -> DataFrame:
    """(u, spans) of the distinct texts with strings that repeat in this or
    another distinct text; spans: first and last start of such strings."""
    places = _texts(docs, seed).select("u", "t").mapInArrow(_places, "key long, u long, at long")
    keys = cut(places.groupBy("key").agg(*_twice(F.xxhash64("u", "at")), F.count(F.lit(1)).alias("n")).where("lo <> hi")
               .select("key", (F.col("n") > hot).alias("hot")))
    kept = (places.join(keys, "key").groupBy("u").agg(F.collect_set(F.struct("key", "at", "hot")).alias("places")))
    # all columns of the texts go along, so this and the last join share one exchange of them
    found = distinct_texts(docs, seed).join(kept, "u").select("u", "t", "n", "places")
    strings = found.mapInArrow(lambda it: _strings(it, False), "key long, u long, at long, left binary, right binary")
    runs = (strings.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u long, first long, last long"))
    if keys.where("hot").take(1):
        windows = found.mapInArrow(lambda it: _strings(it, True), "digest binary, u long, first long")
        twice = windows.groupBy("digest").agg(*_twice(F.xxhash64("u", "first"))).where("lo <> hi").select("digest")
        runs = runs.unionByName(windows.join(twice, "digest").select("u", "first", F.col("first").alias("last")))
    return runs.groupBy("u").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that the strings cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, min(b, n)) for a, b in out]


def _result(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        us, texts, counts, found = (b.column(c).to_pylist() for c in ("u", "t", "n", "spans"))
        texts = [t.encode("utf-8", "surrogatepass") for t in texts]
        own = {k: spans for k, *_, spans in parsed(texts)}
        for k, (u, data, n, spans) in enumerate(zip(us, texts, counts, found)):
            spans = [(s["first"], s["last"]) for s in spans or []] + own.get(k, [])
            runs = [(0, len(data))] if n > 1 and len(data) >= LENGTH else covered(len(data), spans)
            ends = [0, *[e for _, e in runs]]
            left = b"".join([data[a:z] for a, z in zip(ends, [*[s for s, _ in runs], len(data)])])
            rows.append((u, len(data), len(data) - len(left), [{"from": a, "to": z} for a, z in runs],
                         hashlib.sha256(left).hexdigest(), left if with_bytes else None))
        cols = list(zip(*rows)) or [()] * 6
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = [pa.int64()] * 3 + [span, pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["u", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_bytes: bool = False, hot: int = HOT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes,
    n_removed, spans (removed runs [from, to)), kept_sha256 and, with
    ``with_bytes``, the bytes that are left."""
    docs = docs.select("doc_id", "text")
    texts = distinct_texts(docs, seed).join(repeated_spans(docs, hot, seed), "u", "left")
    out = texts.select("u", "t", "n", "spans").mapInArrow(
        lambda it: _result(it, with_bytes),
        "u long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept_sha256 string, kept binary")
    rows = _texts(docs, seed).select("doc_id", "u")
    return rows.join(out if with_bytes else out.drop("kept"), "u").drop("u")


def op2_pfp_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
