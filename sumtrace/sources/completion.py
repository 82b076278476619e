"""Columns and the one table that a reduced set of input tables may lack.

Every rule is integer arithmetic on keys of the same row. A column that the
input already has is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order the rules index them.
SHIP_MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
SHIP_INSTRUCTIONS = ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
CONTAINER_SIZES = ["SM", "LG", "MED", "JUMBO", "WRAP"]
CONTAINER_KINDS = ["CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"]


def _pick(values: list[str], index: Column) -> Column:
    """values[index], index counted from zero."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _with_missing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: v for k, v in rules.items() if k not in df.columns})


def lineitem(df: DataFrame) -> DataFrame:
    o, n, p, s = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    return _with_missing(
        df,
        {
            "l_commitdate": F.date_add("l_shipdate", ((o * 7 + n * 13 + p) % 61 - 30).cast("int")),
            "l_receiptdate": F.date_add("l_shipdate", (1 + (o + n * 5 + s) % 30).cast("int")),
            "l_shipmode": _pick(SHIP_MODES, (o + n) % 7),
            "l_shipinstruct": _pick(SHIP_INSTRUCTIONS, (p + s) % 4),
        },
    )


def part(df: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return _with_missing(
        df,
        {
            "p_mfgr": F.concat(F.lit("Manufacturer#"), (k % 5 + 1).cast("string")),
            "p_container": F.concat_ws(
                " ",
                _pick(CONTAINER_SIZES, k % 5),
                _pick(CONTAINER_KINDS, F.floor(k / 5) % 8),
            ),
        },
    )


def customer(df: DataFrame) -> DataFrame:
    return _with_missing(df, {"c_phone": phone("c_nationkey", "c_custkey")})


def phone(nation: str, key: str) -> Column:
    """A phone number: country code, which is 10 + nation, and three more digits."""
    return F.concat_ws("-", country_code(F.col(nation)), (100 + F.col(key) % 900).cast("string"))


def country_code(nation: Column) -> Column:
    return (nation + 10).cast("string")


def supplier(df: DataFrame) -> DataFrame:
    odd = F.col("s_suppkey") % 20 == 0
    return _with_missing(
        df, {"s_comment": F.when(odd, "x Customer y Complaints").otherwise("ok")}
    )


def orders(df: DataFrame) -> DataFrame:
    odd = F.col("o_orderkey") % 50 == 0
    return _with_missing(
        df,
        {
            "o_comment": F.when(odd, "special x requests").otherwise("reg"),
            "o_shippriority": F.lit(0),
        },
    )


def partsupp(lines: DataFrame) -> DataFrame:
    """One row per (part, supplier) that occurs in the lines."""
    pairs = lines.select(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")
    ).distinct()
    p, s = F.col("ps_partkey"), F.col("ps_suppkey")
    return pairs.withColumns(
        {
            "ps_availqty": 1 + (p * 31 + s * 17) % 9999,
            "ps_supplycost": (100 + (p * 7919 + s * 104729) % 99901) / 100,
        }
    )
