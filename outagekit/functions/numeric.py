"""Numeric helpers shared by the operators.

``round_half`` rounds half away from zero on the double value with plain
IEEE arithmetic (scale, add one half, floor, unscale).  It is written the
same way in the SQL checks, so both engines produce bit-identical results,
and it adds 0.0 so a rounded negative zero prints as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return (F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)) + F.lit(0.0)


def round_half_sql(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + 0.5) / {scale} + 0.0)"


def minutes_to_micros(c: Column) -> Column:
    """Whole microseconds of a duration in minutes, as a decimal: sums do not
    depend on the order rows are added in and do not overflow (a bigint sum
    ends at 2.5e9 customer hours)."""
    return F.round(c * F.lit(60_000_000.0)).cast("decimal(20,0)")


def micros_to_hours(c: Column) -> Column:
    return c.cast("double") / F.lit(3_600_000_000.0)
