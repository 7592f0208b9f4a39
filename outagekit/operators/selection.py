"""Exact order statistics of whole columns by narrowing brackets.

A wanted value is given by its rank among a column's values.  Its bracket - two
values that it lies between - starts as the column's minimum and maximum and
narrows with every read of the table.  One read is one aggregate row for all
columns and ranks: first two splitters per bracket, from a quantile sketch of
the values inside, close to either side of the wanted rank; then how many
values lie below and between them.  Sketches and counts combine map-side, so
a read brings a few numbers per column together and no value is shuffled.
The sketch only proposes: splitters become the bracket if the counts say that
the rank lies between them.

When a bracket's ends are one value, that is the answer (columns of few
values end so).  When few values are left inside, or a read has not narrowed
the bracket, the values inside - and no others - are counted one by one and
ranked.  A round narrows a bracket to about 4 / ACCURACY of its rows, so 10^12
rows take two rounds and the last read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagekit.operators.indicators import rank_pick, ranked_histogram, value_histogram

#: The sketch's rank error is 1 / ACCURACY of its rows.
ACCURACY = 10_000
#: Rows inside brackets that are ranked one by one.
FEW = 1_000_000


def nearest_rank(n: int, q: float) -> int:
    """The 0-based index round((n - 1) q), half away from zero."""
    return int(Decimal(repr((n - 1) * q)).quantize(Decimal(1), ROUND_HALF_UP))


@dataclass
class Bracket:
    """A wanted rank of a column and the values it lies between."""

    column: str
    rank: int
    low: float
    high: float
    below: int  # values less than ``low``
    inside: int  # values from ``low`` to ``high``
    stuck: bool = False

    def open(self) -> bool:
        return not self.stuck and self.low != self.high and self.inside > FEW

    def holds(self) -> Column:
        x = F.col(f"`{self.column}`")
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))

    def sketch(self) -> Column:
        """Splitters on either side of the rank among the values inside."""
        at, step = (self.rank - self.below + 0.5) / self.inside, 2.0 / ACCURACY
        ends = [min(1.0, max(0.0, p)) for p in (at - step, at + step)]
        return F.percentile_approx(F.when(self.holds(), F.col(f"`{self.column}`")), ends, ACCURACY)

    def counts(self, low: float, high: float) -> list[Column]:
        x = F.col(f"`{self.column}`")
        return [F.count_if(x < F.lit(low)), F.count_if((x >= F.lit(low)) & (x <= F.lit(high)))]

    def narrow(self, low: float, high: float, below: int, inside: int) -> None:
        """The splitters' bracket, if it holds the rank and is narrower."""
        if below <= self.rank < below + inside and (inside < self.inside or low == high):
            self.low, self.high, self.below, self.inside = low, high, below, inside
        else:
            self.stuck = True


def order_statistics(df: DataFrame, sizes: dict[str, tuple[int, float, float]], qs: Sequence[float],
                     skew: str = "auto") -> dict[str, list[float]]:
    """Nearest-rank quantiles ``qs`` of the double columns in ``sizes``, which
    has each one's number of values, minimum and maximum.  ``skew``: how the
    values of a last bracket are ranked (``ranked_histogram``)."""
    wanted = [Bracket(c, nearest_rank(n, q), low, high, 0, n) for c, (n, low, high) in sizes.items() for q in qs]
    while brackets := [b for b in wanted if b.open()]:
        splits = df.agg(*[b.sketch().alias(f"s{i}") for i, b in enumerate(brackets)]).first()
        pairs = [tuple(s) for s in splits]
        seen = df.agg(*[c.alias(f"c{i}_{j}") for i, (b, p) in enumerate(zip(brackets, pairs)) for j, c in enumerate(b.counts(*p))]).first()
        for i, (b, p) in enumerate(zip(brackets, pairs)):
            b.narrow(*p, seen[2 * i], seen[2 * i + 1])
    left = [(i, b) for i, b in enumerate(wanted) if b.low != b.high]
    found = {i: b.low for i, b in enumerate(wanted) if b.low == b.high}
    if left:
        inside = F.filter(F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("i"), F.col(f"`{b.column}`").alias("x")))
                                    for i, b in left]), lambda v: v.isNotNull())
        hist = value_histogram(df.select(F.explode(inside).alias("v")).select("v.i", "v.x"), "x", ["i"])
        rank = F.lit(None).cast("long")
        for i, b in left:
            rank = F.when(F.col("i") == i, F.lit(b.rank - b.below)).otherwise(rank)
        ranked = ranked_histogram(hist, "x", ["i"], skew)
        found |= {r.i: r.x for r in ranked.groupBy("i").agg(rank_pick("x", rank).alias("x")).collect()}
    return {c: [found[k * len(qs) + j] for j in range(len(qs))] for k, c in enumerate(sizes)}
