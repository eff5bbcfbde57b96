"""Units of strength, share and length to MPa, percent and mm. Factors are exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millcheck.functions.rounding import exact

# Factors by unit.
STRENGTH = {"kgf/mm2": "9.80665", "kgf/mm²": "9.80665", "psi": "0.006894757293168361", "ksi": "6.894757293168361"}
LENGTH = {"cm": "10", "m": "1000", "inch": "25.4", "in": "25.4"}


def scaled(value: Column, unit: Column, factors: dict[str, str]) -> Column:
    """value times the factor of its unit; other units, null among them, count as the target unit."""
    u, out = F.lower(F.trim(unit)), None
    for name, factor in factors.items():
        product = (exact(value).cast("double") * float(factor))
        out = F.when(u == name, product) if out is None else out.when(u == name, product)
    return out.otherwise(value)


def to_mpa(value: Column, unit: Column) -> Column:
    return scaled(value, unit, STRENGTH)


def to_mm(value: Column, unit: Column) -> Column:
    return scaled(value, unit, LENGTH)


def to_percent(value: Column, unit: Column) -> Column:
    return value.cast("double")
