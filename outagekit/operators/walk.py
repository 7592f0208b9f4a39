"""The walk that keeps the longer of strictly overlapping intervals.

The state of the walk is one kept interval, the champion.  A row that does
not strictly overlap it, or is longer, becomes the champion; any other row is
dropped.  The old champion stays if the new one does not overlap it and goes
if it does.  So the champion only ever changes to a row of its own, and a
walk that starts late with another champion comes to the same one soon.

``walked`` runs sorted rows through one walk per task.  ``walked_in_chunks``
runs one consumer's walk over many tasks.  The rows are range-partitioned and
sorted by (consumer, order) and checkpointed, so a chunk is a partition that
is read again in order, without another exchange or sort:

1. every chunk is walked from no champion;
2. the last champion of a consumer that goes on in the next chunk is handed
   to it.  A chunk whose latest start and longest row cannot end the champion
   passes it on unseen; any other is walked again with it.  If that gives the
   champion at its end that was supposed, all that follows stands; if not, the
   chunks behind it are walked again;
3. with every chunk's incoming champion settled, and the fate of the one it
   hands on, the rows are flagged.

Only a chunk's first consumer can have a champion from before and only its
last one can hand one on, so one small row per chunk comes to the driver and
one goes back.  Chunks are settled from the front, at least one a round; as
walks join within a few rows, two rounds do unless champions change in a way
that outlasts whole chunks.

Workers' functions are nested, so they travel with the job and executors need
not have this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.operators.scan import CHUNK
from outagekit.session import checkpoint_dir

#: Of a chunk: its first and last consumer, the champion that came in, the
#: first consumer's at its end, what became of the one that came in, the first
#: consumer's latest start and greatest length, the last consumer's champion.
STATE = (f"{CHUNK} int, head string, tail string, one boolean, in_s long, in_e long, out_s long, out_e long, "
         "fate string, max_s long, max_len long, tail_s long, tail_e long")


def walked(rows: DataFrame, n_cols: int, schema: T.StructType) -> DataFrame:
    """``rows`` - sorted, ``n_cols`` columns and ``__new`` (no overlap with an
    earlier row), ``__alone`` (nor with a later one), ``__sus``, ``__eus`` -
    as those columns and ``__keep``."""
    return rows.mapInArrow(_island_walk(n_cols), schema)


def walked_in_chunks(rows: DataFrame, key: str, order: list[Column], names: list[Column], bounds: list[Column],
                     schema: T.StructType, n_chunks: int) -> DataFrame:
    """``rows`` as the columns ``names`` and ``__keep``; ``bounds`` are the
    interval in microseconds.  A null ``key`` is a consumer like any other."""
    checkpoint_dir(rows.sparkSession)  # raises before any work where there is none
    k = F.col(f"`{key}`")
    dealt = (rows.repartitionByRange(n_chunks, k, *order).sortWithinPartitions(k, *order)
             .select(*names, k.cast("string").alias("__key"), F.spark_partition_id().alias(CHUNK), *bounds).checkpoint(eager=True))
    n = len(names)
    lean = dealt.select(*dealt.columns[n:])
    chunks = {r[CHUNK]: r.asDict() for r in lean.mapInArrow(_chunk_states({}), STATE).collect()}
    while again := settle(chunks):
        seen = lean.where(F.col(CHUNK).isin(list(again))).mapInArrow(_chunk_states(again), STATE)
        chunks |= {r[CHUNK]: r.asDict() for r in seen.collect()}
    settled = {c: (r["in_s"], r["in_e"], r["out_kept"]) for c, r in chunks.items()}
    return dealt.mapInArrow(_chunk_flags(n, settled), schema)


def settle(chunks: dict[int, dict]) -> dict[int, tuple[int, int]]:
    """Hand champions on from chunk to chunk.  Returns the chunks that would
    get another champion than they were walked with and cannot let it pass,
    with that champion.  Where there is none, every chunk learns whether the
    champion it hands on stays (``out_kept``)."""
    again, tail, now = {}, None, None
    rows = [chunks[c] for c in sorted(chunks)]
    for r in rows:
        came = now if r["head"] == tail and now is not None and r is not rows[0] else None
        r["goes_on"] = came is not None
        if came != ((r["in_s"], r["in_e"]) if r["in_s"] is not None else None):
            if came is not None and r["max_s"] < came[1] and r["max_len"] <= came[1] - came[0]:
                r["in_s"], r["in_e"], r["out_s"], r["out_e"], r["fate"] = *came, *came, "pass"
            else:
                again[r[CHUNK]] = came or (None, None)
        tail = r["tail"]
        now = (r["out_s"], r["out_e"]) if r["one"] else (r["tail_s"], r["tail_e"])
    kept = True  # what becomes of the champion that the chunk before hands on
    for r in reversed(rows):
        r["out_kept"] = kept
        if not r["goes_on"]:
            kept = True
        elif r["fate"] != "pass":
            kept = r["fate"] != "lost"
        elif not r["one"]:
            kept = True  # its consumer ends in this chunk
    return again


def _chunk_states(champions: dict[int, tuple[int, int]]):
    """Walk each chunk, its first consumer from the champion given: one row
    per chunk."""

    def states(batches):
        import pyarrow as pa

        at = chunk = head = tail = fate = None
        came, first_end = (None, None), None
        cs = ce = last = None
        longest = 0
        one = True
        for batch in batches:
            keys, numbers, start, end = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                if at is None:
                    at, chunk, head, tail = 0, numbers[i], keys[i], keys[i]
                    came = tuple(champions.get(chunk, (None, None)))
                    cs, ce = came
                    fate = None if cs is None else "pass"
                elif keys[i] != tail:
                    if one:
                        one, first_end = False, (cs, ce)
                    cs = ce = None
                    tail = keys[i]
                s, e = start[i], end[i]
                if one:
                    last, longest = s, max(longest, e - s)  # starts are in order
                rival = cs is not None and s < ce and e > cs
                if rival and e - s <= ce - cs:
                    continue
                if one and fate == "pass":
                    fate = "lost" if rival else "kept"
                cs, ce = s, e
        if at is not None:
            out = (cs, ce) if one else first_end
            row = [chunk, head, tail, one, *came, *out, fate, last, longest, cs, ce]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[f"c{i}" for i in range(len(row))])

    return states


def _chunk_flags(n_cols: int, settled: dict[int, tuple]):
    """Flag the rows of each chunk, its first consumer walked from the
    incoming champion; the champion at the chunk's end stays if so settled,
    one at a consumer's end within the chunk always does.  The first
    ``n_cols`` columns go through untouched."""

    def flags(batches):
        import numpy as np
        import pyarrow as pa

        def flagged(batch, keep):
            cols = [batch.column(i) for i in range(n_cols)] + [pa.array(keep, pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(n_cols + 1)])

        cs = ce = key = None
        stays = True  # whether the champion at the chunk's end does
        begun = False
        held = None  # the champion's one-row batch, if it came in an earlier one
        for batch in batches:
            keys, chunk, start, end = (batch.column(n_cols + i).to_pylist() for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            at = -1  # the champion's row in this batch; -1: in ``held``, or of another chunk
            for i in range(batch.num_rows):
                if not begun:
                    begun, key = True, keys[i]
                    cs, ce, stays = settled[chunk[i]]
                elif keys[i] != key:
                    if at >= 0:
                        keep[at] = True
                    elif held is not None:
                        yield flagged(held, [True])
                    at, held, cs, ce, key = -1, None, None, None, keys[i]
                s, e = start[i], end[i]
                rival = cs is not None and s < ce and e > cs
                if rival and e - s <= ce - cs:
                    continue
                if at >= 0:
                    keep[at] = not rival
                elif held is not None:
                    yield flagged(held, [not rival])
                    held = None
                at, cs, ce = i, s, e
            if at >= 0:
                held = batch.slice(at, 1)
                others = np.arange(batch.num_rows) != at
                yield flagged(batch.filter(pa.array(others)), keep[others])
            else:
                yield flagged(batch, keep)
        if held is not None:
            yield flagged(held, [stays])

    return flags


def _island_walk(n_cols: int):
    """One walk over sorted islands: the first ``n_cols`` columns go through
    untouched, with a flag whether the row is kept.  Rows alone in their
    island are kept without being looked at."""

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        def flagged(batch, keep):
            cols = [batch.column(i) for i in range(n_cols)] + [pa.array(keep, pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(n_cols + 1)])

        held = None  # (start, end, its one-row batch): the champion of an earlier batch
        for batch in batches:
            keep = batch.column("__alone").to_numpy(zero_copy_only=False).copy()
            rows = np.flatnonzero(~keep)
            some = pa.array(rows)
            new, start, end = (batch.column(c).take(some).to_pylist() for c in ("__new", "__sus", "__eus"))
            at = -1  # the champion among ``rows``; -1: it came earlier
            for i in range(len(rows)):
                cs, ce = (start[at], end[at]) if at >= 0 else held[:2] if held else (0, 0)
                rival = not new[i] and start[i] < ce and end[i] > cs
                if rival and end[i] - start[i] <= ce - cs:
                    continue
                if at >= 0:
                    keep[rows[at]] = not rival
                elif held:
                    yield flagged(held[2], [not rival])
                    held = None
                at = i
            if at >= 0:
                held = (start[at], end[at], batch.slice(rows[at], 1))
                others = np.arange(batch.num_rows) != rows[at]
                yield flagged(batch.filter(pa.array(others)), keep[others])
            else:
                yield flagged(batch, keep)
        if held:
            yield flagged(held[2], [True])

    return walk
