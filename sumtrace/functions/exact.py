"""Exact sums of whole numbers in primitive arithmetic.

Money is held in whole cents and rates in whole percent, so every product is a
BIGINT. A plain BIGINT sum overflows near 9e18 and a DECIMAL sum leaves
primitive arithmetic for every row. Summing the high and the low 20 bits apart
stays in two BIGINT sums, is combined map-side, and is exact up to 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20
LOW_MASK = (1 << LOW_BITS) - 1


def scaled(col: Column | str, factor: int) -> Column:
    """A fixed-point column as a whole number of 1/factor units."""
    return F.rint(F.col(col) * factor if isinstance(col, str) else col * factor).cast("bigint")


def split_sums(x: Column, name: str) -> list[Column]:
    """Aggregates ``<name>_hi`` and ``<name>_lo``; combine them with :func:`total`."""
    return [
        F.sum(F.shiftright(x, LOW_BITS)).alias(f"{name}_hi"),
        F.sum(x.bitwiseAND(F.lit(LOW_MASK))).alias(f"{name}_lo"),
    ]


def resum(name: str, keep: Column | None = None) -> list[Column]:
    """Aggregate already split sums once more, optionally only where ``keep`` holds."""

    def part(side: str) -> Column:
        c = F.col(f"{name}_{side}")
        return F.sum(c if keep is None else F.when(keep, c).otherwise(F.lit(0)))

    return [part("hi").alias(f"{name}_hi"), part("lo").alias(f"{name}_lo")]


def total(name: str) -> Column:
    """The DECIMAL value of a pair of split sums."""
    return _join(F.col(f"{name}_hi"), F.col(f"{name}_lo"))


def exact_sum(x: Column) -> Column:
    """One aggregate expression: the exact DECIMAL sum of a BIGINT column."""
    hi, lo = split_sums(x, "s")
    return _join(hi, lo)


def _join(hi: Column, lo: Column) -> Column:
    return hi.cast("decimal(20,0)") * F.lit(1 << LOW_BITS) + lo.cast("decimal(20,0)")
