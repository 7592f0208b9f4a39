"""SentencePiece BPE with seeded merge-dropout (operator 3).

A text becomes merge-type pieces of a given vocabulary file: a blank is put
before it, the symbols are its characters, and an agenda (heap) of adjacent
pairs merges the best-scored pair first, the leftmost of equals.  Dropout
skips a candidate merge, when its turn comes, if a hash keyed by the seed, the
document, the word's place in it and the candidate's place falls below
``dropout``; with 0 the pieces are the vocabulary's own segmentation.  What the vocabulary does
not cover becomes byte pieces, so every text decodes to exactly itself; a
literal U+2581 does too, unlike in the library, as it is not taken for a blank.

No piece has a blank after another character, so no merge crosses the start
of a word (blanks and what follows them): words are segmented one by one,
each occurrence with its own draws.  A task remembers the merges of a word
without dropout: an occurrence none of whose draws skips one of them has the
same pieces, any other runs its own agenda.

Defined results: null text gives null ids, empty text none; a document
without doc_id is keyed by its text instead; an empty table gives an empty result; other columns
are passed through (``encoded``) or not read (``encode``).
"""

from __future__ import annotations

import copy
import heapq
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: Words up to this length merge in bulk; words a task remembers
#: (besides those of the batch at hand).
SHORT, REMEMBERED = 24, 150_000
#: Documents of an output batch.
ROWS = 256
MASK = (1 << 64) - 1


def vocabulary(path: str = MODEL) -> dict:
    """Pieces of a SentencePiece BPE model, blanks as blanks: rank of each
    (0 merges first), ids of the byte pieces, bytes of every id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, byte_ids, spelled = {}, [0] * 256, []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            spelled.append(bytes([int(piece[1:-1], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            spelled.append(b"")
        else:
            plain[piece.replace("▁", " ")] = (-m.get_score(i), i)
            spelled.append(piece.replace("▁", " ").encode())
    joins = "".join(p for p in plain if len(p) > 1)
    alone = "".join(c for c in "\n\t" if c not in joins)  # in no longer piece: merges stop there
    if any(" " in p.lstrip(" ") for p in plain):
        raise ValueError("pieces with blanks inside: words are not independent")
    return {"id": hash(m.serialized_model_proto()), "ranks": plain, "bytes": byte_ids, "spelled": spelled,
            "words": rf" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else "")}


def _place(left: int, size: int) -> int:
    """What stands for a candidate merge in its hash."""
    return (left * 0x9E3779B97F4A7C15 + size * 0xD6E8FEB86659FD93) & MASK


def _places(left: np.ndarray, size: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def _mix_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment(word: str, vocab: dict, key: int = 0, dropout: float = 0.0, trace: list | None = None) -> list[int]:
    """Ids of ``word``: agenda of merges, each skipped where its keyed hash
    says so.  The places of the merges made go to ``trace``."""
    ranks, cutoff = vocab["ranks"], int(dropout * (1 << 64))
    part = list(word)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    agenda = []

    def propose(left: int) -> None:
        right = after[left]
        if left >= 0 and right < len(part):
            found = ranks.get(part[left] + part[right])
            if found:
                heapq.heappush(agenda, (found[0], left, right, len(part[left]) + len(part[right])))

    for i in range(len(part) - 1):
        propose(i)
    while agenda:
        _, left, right, size = heapq.heappop(agenda)
        if not part[left] or not part[right] or len(part[left]) + len(part[right]) != size:
            continue
        if cutoff and _mix(key ^ _place(left, size)) < cutoff:
            continue
        if trace is not None:
            trace.append(_place(left, size))
        part[left] += part[right]
        part[right] = ""
        after[left] = after[right]
        if after[left] < len(part):
            before[after[left]] = left
            propose(left)
        if before[left] >= 0:
            propose(before[left])
    ids = []
    for p in part:
        if p:
            found = ranks.get(p)
            ids += [found[1]] if found else [vocab["bytes"][b] for b in p.encode("utf-8", "surrogatepass")]
    return ids


class Merges:
    """The agenda run on many words at once: each round merges, in every word
    at a time, its best pair that is not skipped (the leftmost of equals), so
    each word goes through the same merges as in ``segment``."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocab: dict, dropout: float):
        self.vocab, self.dropout, self.cutoff = vocab, dropout, np.uint64(int(dropout * (1 << 64)))
        ranks = vocab["ranks"]
        pairs = [(ranks[p[:i]][1] << 20 | ranks[p[i:]][1], r, n) for p, (r, n) in ranks.items()
                 for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        size = 1 << (3 * len(pairs)).bit_length()
        self.mask = np.int64(size - 1)
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for key, r, n in pairs:
            at = int(self._slot(np.int64(key)))
            tries = 1
            while self.keys[at] >= 0:
                at, tries = (at + 1) & int(self.mask), tries + 1
            self.keys[at], self.rank[at], self.merged[at] = key, int(r), n
            self.probes = max(self.probes, tries)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, (_, n) in ranks.items():
            if len(p) == 1:
                self.chars[ord(p)] = n

    def skipping(self, dropout: float) -> Merges:
        """The same merges with another dropout."""
        other = copy.copy(self)
        other.dropout, other.cutoff = dropout, np.uint64(int(dropout * (1 << 64)))
        return other

    def _slot(self, key):
        return ((key >> 20) * 40503 ^ (key & 0xFFFFF) * 60493) & self.mask

    def _pairs(self, left: np.ndarray, right: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of adjacent pieces, NONE where they do not merge
        or are skipped."""
        want = left.astype(np.int64) << 20 | right
        want[right < 0] = -2
        at = self._slot(want)
        for _ in range(self.probes):
            off = (self.keys[at] != want) & (self.keys[at] != -1)
            if not off.any():
                break
            at = np.where(off, (at + 1) & self.mask, at)
        rank = np.where(self.keys[at] == want, self.rank[at], self.NONE)
        if self.cutoff:
            rank[_mix_all(key ^ _places(start, stop - start)) < self.cutoff] = self.NONE
        return rank, self.merged[at]

    def _one(self, word: str, key: int, j: int, traces: list[tuple] | None) -> bytes:
        made: list[int] = []
        ids = segment(word, self.vocab, int(key), self.dropout, made)
        if traces is not None:
            traces.append((np.full(len(made), j), np.array(made, np.uint64)))
        return np.array(ids, np.int32).tobytes()

    def segment_all(self, words: list[str], keys: list[int] | np.ndarray, traces: list[tuple] | None = None) -> list[bytes]:
        """Packed ids of each word.  ``traces`` gets (words, places) arrays of
        the merges made, those of a word in their order."""
        out: list = [None] * len(words)
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
        at = 0
        while at < len(order):
            part = order[at:at + 4096]
            at += len(part)
            width = len(words[part[-1]])
            if width > SHORT:
                cut = next(i for i, j in enumerate(part) if len(words[j]) > SHORT)
                for j in part[cut:]:
                    out[j] = self._one(words[j], keys[j], j, traces)
                part = part[:cut]
                if not part:
                    continue
                width = len(words[part[-1]])
            self._run(part, words, keys, width, out, traces)
        return out

    def _run(self, part: list[int], words: list[str], keys: list[int], width: int, out: list, traces: list[tuple] | None) -> None:
        n = len(part)
        codes = np.frombuffer("".join([words[j].ljust(width, "\0") for j in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        lens = np.array([len(words[j]) for j in part])
        ids = self.chars[codes]
        real = np.arange(width) < lens[:, None]
        odd = ((ids < 0) & real).any(1)
        for r in np.flatnonzero(odd):  # byte pieces
            out[part[r]] = self._one(words[part[r]], keys[part[r]], part[r], traces)
        ids[~real] = -1
        # one more place: the end of the last piece
        start = np.minimum(np.arange(width + 1), lens[:, None]).astype(np.int32)
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
        key = np.array([keys[j] for j in part], np.uint64)
        rows, named = np.flatnonzero(~odd), np.array(part)
        ids, start, key, lens = ids[rows], start[rows], key[rows], lens[rows]
        rank, made = self._pairs(ids[:, :-1], ids[:, 1:], start[:, :-1], np.concatenate([start[:, 2:], start[:, -1:]], axis=1), key[:, None])
        while len(rows):
            best = rank.argmin(1)
            line = np.arange(len(rows))
            done = rank[line, best] == self.NONE
            if done.any():
                ended, size = ids[done].tobytes(), 4 * ids.shape[1]
                for at, j, n in zip(range(0, len(ended), size), named[rows[done]].tolist(), lens[done].tolist()):
                    out[j] = ended[at:at + 4 * n]
                go = ~done
                rows, ids, start, key, lens, rank, made, best = (x[go] for x in (rows, ids, start, key, lens, rank, made, best))
                w = int(lens.max(initial=1))
                ids, start, rank, made = ids[:, :w + 1], start[:, :w + 1], rank[:, :w], made[:, :w]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            w = ids.shape[1]
            if traces is not None:
                traces.append((named[rows], _places(start[line, best], start[line, np.minimum(best + 2, w - 1)] - start[line, best])))
            ids[line, best] = made[line, best]
            lens = lens - 1
            # the right piece and its pair go: one place less in every row
            stay = np.ones((len(rows), w), bool)
            stay[line, best + 1] = False
            ids, start = ids[stay].reshape(-1, w - 1), start[stay].reshape(-1, w - 1)
            stay = stay[:, :-1]
            rank, made = rank[stay].reshape(-1, w - 2), made[stay].reshape(-1, w - 2)
            w -= 1
            for j in (best, best - 1):
                ok = np.flatnonzero((j >= 0) & (j + 1 < lens))
                i = j[ok]
                end = start[ok, np.minimum(i + 2, w - 1)]
                rank[ok, i], made[ok, i] = self._pairs(ids[ok, i], ids[ok, i + 1], start[ok, i], end, key[ok])
            last = np.flatnonzero((best + 1 >= lens) & (best < w - 1))
            rank[last, best[last]] = self.NONE


class Encoder:
    """Encodes texts, remembering words as they are without dropout."""

    def __init__(self, vocab: dict, dropout: float = DROPOUT, seed: int = SEED):
        self.vocab, self.seed, self.find, self.dropout = vocab, seed, re.compile(vocab["words"]).findall, dropout
        self.cutoff = np.uint64(int(dropout * (1 << 64)))
        self.number: dict[str, int] = {}
        # of each word by its number: packed ids, and where the places of its merges are
        self.packed: list[bytes] = []
        self.first = np.zeros(1, np.int64)
        self.places = np.zeros(0, np.uint64)
        self.plain: Merges | None = None
        self.dropping: Merges | None = None
        self.spelled = pa.array(vocab["spelled"], pa.binary())

    def _learn(self, new: list[str]) -> None:
        """Segment words not known yet, without dropout."""
        if self.plain is None:
            self.plain = Merges(self.vocab, 0.0)
            self.dropping = self.plain.skipping(self.dropout)
        traces: list[tuple] = []
        packed = self.plain.segment_all(new, [0] * len(new), traces)
        self.number.update(zip(new, range(len(self.packed), len(self.packed) + len(new))))
        self.packed += packed
        of = np.concatenate([np.zeros(0, np.int64), *[t[0] for t in traces]])
        places = np.concatenate([np.zeros(0, np.uint64), *[t[1] for t in traces]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.places = np.concatenate([self.places, places[np.argsort(of, kind="stable")]])

    def _forget(self, known: int, new: list[str]) -> None:
        for w in new:
            del self.number[w]
        del self.packed[known:]
        self.first = self.first[:known + 1].copy()
        self.places = self.places[:self.first[-1]].copy()

    def _keys(self, texts: list[str | None], docs: list[int | None], n: list[int]) -> np.ndarray:
        """Key of every word: seed, document and its place there."""
        named = [f"{self.seed}/{d}" if d is not None else f"{self.seed}//{t}" for t, d in zip(texts, docs)]
        base = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in named], np.uint64)
        ends = np.cumsum(n)
        place = np.arange(1, ends[-1] + 1 if n else 1) - np.repeat(ends - n, n)
        return _mix_all(np.repeat(base, n) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _skipped(self, number: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The words (their index) that skip a merge they have without dropout."""
        first = self.first[number]
        n = self.first[number + 1] - first
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) + np.repeat(first - np.cumsum(n) + n, n)
        hit = np.zeros(len(n), bool)
        hit[of[_mix_all(keys[of] ^ self.places[at]) < self.cutoff]] = True
        return np.flatnonzero(hit)

    def encode_all(self, texts: list[str | None], docs: list[int | None]) -> list[np.ndarray | None]:
        words = [self.find(" " + t) if t else [] for t in texts]
        n = [len(ws) for ws in words]
        every = list(chain.from_iterable(words))
        known, new = len(self.packed), []
        number = list(map(self.number.get, every))
        if None in number:
            new = list(dict.fromkeys(w for w, k in zip(every, number) if k is None))
            self._learn(new)
            number = list(map(self.number.__getitem__, every))
        packed = list(map(self.packed.__getitem__, number))
        if self.dropout and every:
            keys = self._keys(texts, docs, n)
            skipped = self._skipped(np.array(number), keys)
            drawn = skipped.tolist()
            for i, ids in zip(drawn, self.dropping.segment_all([every[i] for i in drawn], keys[skipped])):
                packed[i] = ids
        ends = np.cumsum([0, *n]).tolist()
        out = [None if t is None else np.frombuffer(b"".join(packed[a:b]), np.int32) for t, a, b in zip(texts, ends, ends[1:])]
        if len(self.packed) > REMEMBERED:  # what came first is what is common: it stays
            self._forget(known, new)
        return out

    def encode(self, text: str | None, doc: int | None = None) -> np.ndarray | None:
        return self.encode_all([text], [doc])[0]

    def _spelled(self, ids: np.ndarray) -> bytes:
        """What the pieces spell, without the blank before the text."""
        if not len(ids):
            return b""
        _, ends, data = self.spelled.take(pa.array(ids, pa.int32())).buffers()
        return data.to_pybytes()[1:np.frombuffer(ends, np.int32)[len(ids)]] if data else b""

    def decode(self, ids: np.ndarray) -> str:
        return self._spelled(ids).decode("utf-8", "surrogatepass")

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether the ids decode to the text (compared as bytes, as ids may
        spell what is no text)."""
        return self._spelled(ids) == text.encode("utf-8", "surrogatepass")


def _remembering(vocab: dict, dropout: float, seed: int) -> Encoder:
    """The encoder of this worker process: its next tasks go on with what
    earlier ones remembered."""
    kept = sys.modules.setdefault("bpe_dropout_memory", types.ModuleType("bpe_dropout_memory")).__dict__
    key = (vocab["id"], dropout, seed)
    if kept.get("key") != key:
        kept.update(key=key, encoder=Encoder(vocab, dropout, seed))
    return kept["encoder"]


def _encode(batches: Iterator[pa.RecordBatch], names: list[str], how: tuple) -> Iterator[pa.RecordBatch]:
    encoder = _remembering(*how)
    id_col, text_col, keep = names[0], names[1], names[2:]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            docs, texts = b.column(id_col).to_pylist(), b.column(text_col).to_pylist()
            ids = encoder.encode_all(texts, docs)
            same = [None if t is None else encoder.spells(i, t) for i, t in zip(ids, texts)]
            n = np.array([0 if i is None else len(i) for i in ids])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.array([i is None for i in ids] + [False])),
                pa.array(np.concatenate([np.zeros(0, np.int32), *[i for i in ids if i is not None]])))
            out = [b.column(c) for c in keep] + [lists, pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                                                 pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])


def encoded(docs: DataFrame, keep: list[str] | None = None, model: str = MODEL, dropout: float = DROPOUT,
            seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text) with its columns ``keep`` (all by default) and
    ids, n_ids, lossless - whether the ids, decoded, are the text.  An input
    column of one of these names makes way for it."""
    new = [("ids", "array<int>"), ("n_ids", "long"), ("lossless", "boolean")]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [n for n, _ in new]]
    how = (vocabulary(model), dropout, seed)
    # plain names inside, whatever the columns are called; the id and the text go along once
    sent = keep + [c for c in ("doc_id", "text") if c not in keep]
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sent)]
    names = [f"k{sent.index(c)}" for c in ("doc_id", "text")] + [f"k{i}" for i in range(len(keep))]
    fields = [docs.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in new]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    out = docs.select(*cols).mapInArrow(lambda it: _encode(it, names, how), inner)
    return out.toDF(*[f.name for f in fields])


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of its ``ids``."""
    decoder = Encoder(vocabulary(model), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if r is None else decoder.decode(np.array(r, np.int32)) for r in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def op3_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep=["doc_id"])
