"""Arithmetic helpers that keep IEEE results under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """Float division: x/0 is an infinity with the sign of x, 0/0 is NaN."""
    x, y = a.cast("double"), b.cast("double")
    return (
        F.when(y != 0, x / F.when(y != 0, y))
        .when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(
            x.isNotNull(), F.lit(float("nan"))))
    )


def ratio(a: Column, b: Column) -> Column:
    """Double division with NULL for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def next_power_of_two(n: Column) -> Column:
    """Smallest power of two >= n for n >= 1 (0 gives 2, as |n - 1| has one bit)."""
    return (
        F.when(n == 1, F.lit(1).cast("bigint"))
        .when(n == 0, F.lit(2).cast("bigint"))
        .otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n - 1))))
    )


def mib(c: Column) -> Column:
    return c / F.lit(1048576.0)


def unsigned(c: Column) -> Column:
    """The unsigned value of a 64-bit field, which tables keep as a long with the same bits."""
    n = c.cast("decimal(20,0)")
    return F.when(c < 0, n + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(n).cast("decimal(20,0)")


def wrapped(c: Column) -> Column:
    """The long with the low 64 bits of a whole decimal, where long arithmetic would overflow."""
    half, full = (F.lit(str(1 << k)).cast("decimal(20,0)") for k in (63, 64))
    return (F.pmod(c + half, full) - half).cast("bigint")
