"""Rounding to even on the exact decimal text of a number, and comparison with limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"


def exact(value: Column) -> Column:
    """A double as the decimal number that its shortest text says; null if that does not fit."""
    return value.cast("string").try_cast(EXACT)


def once(c: Column, make) -> Column:
    """make(c), with c worked out once however often it is used."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def half_even(value: Column, decimals: int | Column) -> Column:
    """Round half to even, as double. decimals may be a column; null, and what the value has no digits for (over 18
    decimals, or a value of 1e20 and more), leave the value as it is."""
    if isinstance(decimals, int):
        return F.coalesce(F.bround(exact(value), decimals).cast("double"), value) if decimals <= 18 else value

    def rounded(d: Column) -> Column:
        out = F.when(decimals == 0, F.bround(d, 0).cast("double"))
        for k in range(1, 19):
            out = out.when(decimals == k, F.bround(d, k).cast("double"))
        return out

    return F.coalesce(F.when(decimals.isNotNull(), once(exact(value), rounded)), value)


def compare(value: Column, limit: Column, op: str, decimals: int | None = None) -> tuple[Column, Column]:
    """Whether value op limit holds, for op among <=, <, >=, >, == , and the deviation: positive is beyond the limit."""
    v, m = value if decimals is None else half_even(value, decimals), limit
    # doubles are in the order of their shortest texts; only differences need the exact numbers
    holds = {"<=": v <= m, "<": v < m, ">=": v >= m, ">": v > m, "==": v == m}[op]
    return holds, difference(v, m) if op in ("<=", "<", "==") else difference(m, v)


def difference(a: Column, b: Column) -> Column:
    """a - b of the exact numbers, as double."""
    return F.coalesce((exact(a) - exact(b)).cast("double"), a - b)
