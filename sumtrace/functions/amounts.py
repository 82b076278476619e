"""Line amounts in whole units: cents, percent, pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def disc_price() -> Column:
    """price * (100 - discount), in 1/10^4 of the currency."""
    return F.col("l_extendedprice") * (F.lit(100) - F.col("l_discount"))


def charge() -> Column:
    """price * (100 - discount) * (100 + tax), in 1/10^6 of the currency."""
    return disc_price() * (F.lit(100) + F.col("l_tax"))


def profit() -> Column:
    """Discounted price less supply cost, in 1/10^4 of the currency."""
    return disc_price() - F.lit(100) * F.col("ps_supplycost") * F.col("l_quantity")


def year_of(col: str) -> Column:
    return F.year(F.col(col)).cast("int")


def day(col: str) -> Column:
    return F.col(col).cast("date").alias(col)
