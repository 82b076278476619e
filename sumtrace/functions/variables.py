"""Names and numbers of hidden values.

A hidden value is named ``<tag>_<row>``. The tag tells the column, the row part
tells the base-table row. Line items carry order, line, part and supplier in
their row part, so a name stays distinct where (order, line) is not a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag of each sensitive column, the table's row, its divisor to base units.
SENSITIVE = {
    "part": {"p_retailprice": "x1"},
    "supplier": {"s_acctbal": "x2"},
    "partsupp": {"ps_availqty": "x3", "ps_supplycost": "x4"},
    "customer": {"c_acctbal": "x5"},
    "orders": {"o_totalprice": "x6"},
    "lineitem": {
        "l_quantity": "x7",
        "l_extendedprice": "x8",
        "l_discount": "x9",
        "l_tax": "x10",
    },
}

# Fixed value: the most lines an order may have.
LINES_PER_ORDER = 7


def row_parts(table: str) -> list[Column]:
    """The keys that tell a table's row, as they stand in a variable's name."""
    c = F.col
    return {
        "part": [c("p_partkey")],
        "supplier": [c("s_suppkey")],
        "partsupp": [c("ps_partkey"), c("ps_suppkey")],
        "customer": [c("c_custkey")],
        "orders": [c("o_orderkey")],
        "lineitem": [
            c("l_orderkey") * LINES_PER_ORDER + c("l_linenumber") - 1,
            c("l_partkey"),
            c("l_suppkey"),
        ],
    }[table]


def row_part(table: str) -> Column:
    """The row part of a variable name as a string column."""
    return F.concat_ws("_", *[p.cast("string") for p in row_parts(table)])


def variable(tag: str, row: Column | str) -> Column:
    return F.concat(F.lit(tag + "_"), F.col(row) if isinstance(row, str) else row)


def variable_code(prefix: Column, suffix: Column, factor: int) -> Column:
    """One number per variable: prefix * factor + suffix."""
    return prefix.cast("bigint") * factor + suffix.cast("bigint")


def renumber(text: Column, factor: int) -> Column:
    """Replace every ``x<prefix>_<suffix>`` in a text by ``x<prefix*factor+suffix>``."""
    name = r"x\d+_\d+"
    between = F.split(text, name, -1)
    found = F.regexp_extract_all(text, F.lit(f"({name})"), F.lit(1))

    def code(n: Column) -> Column:
        digits = F.split(F.substring(n, F.lit(2), F.length(n)), "_")
        return F.concat(F.lit("x"), variable_code(digits[0], digits[1], factor).cast("string"))

    pieces = F.zip_with(
        between, F.transform(found, code), lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))
    )
    return F.array_join(pieces, "")
