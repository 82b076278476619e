"""Inserts and deletes of orders with their lines, and columns derived from rows.

Keys that come in are distinct and small against the tables, but the joins carry
no broadcast hint: Spark decides by size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.exact import exact_sum
from sumtrace.sources.changes import Changes
from sumtrace.sources.completion import country_code

# A refresh is a thousandth of all orders; the day statuses refer to.
REFRESH_SHARE = 1000
CURRENT_DAY = date(1995, 6, 17)

# Ranges that a search for a rank counts at once.
RANGES = 1000

# Low bits kept and sequence bits inserted in a sparse key.
KEEP_BITS = 3
SEQUENCE_BITS = 2

# Suppliers per part; the first day of the week that year weeks start from.
SUPPLIERS_PER_PART = 4
FIRST_WEEKDAY = 3


def insert_orders(
    orders: DataFrame, lines: DataFrame, new_orders: DataFrame, new_lines: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Orders and lines after an insert; an order whose key is taken stays out with its lines."""
    fresh = new_orders.join(orders.select("o_orderkey"), "o_orderkey", "left_anti")
    kept = new_lines.join(fresh, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return (
        orders.unionByName(fresh.select(*orders.columns)),
        lines.unionByName(kept.select(*lines.columns)),
    )


def delete_orders(
    orders: DataFrame, lines: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Orders and lines without the orders named in ``keys(orderkey)``."""
    gone = keys.select(F.col("orderkey")).distinct()
    return (
        orders.join(gone, F.col("o_orderkey") == F.col("orderkey"), "left_anti"),
        lines.join(gone, F.col("l_orderkey") == F.col("orderkey"), "left_anti"),
    )


def apply_streams(orders: DataFrame, lines: DataFrame, changes: Changes) -> tuple[DataFrame, DataFrame]:
    """Orders and lines after all streams in the order of their numbers, each insert before its delete.

    The same as :func:`insert_orders` and :func:`delete_orders` once per stream, in one step for any
    number of streams: only what comes after the last delete of a key counts, and of that the first
    (later inserts find the key taken). What is there before the streams comes first of all, if
    no stream deletes it. Lines go with the order of their own stream. Keys are settled among the changes
    alone; the tables themselves are only filtered by them, so they are not shuffled as long as
    the keys are few enough for Spark to send them.
    """
    gone = changes.deletes.groupBy("orderkey").agg(F.max("stream").alias("gone_in"))
    old_orders = orders.join(gone, F.col("o_orderkey") == F.col("orderkey"), "left_anti")
    old_lines = lines.join(gone, F.col("l_orderkey") == F.col("orderkey"), "left_anti")
    offered = changes.orders.select(F.col("o_orderkey").alias("key"), "stream").distinct()
    later = offered.join(gone, F.col("key") == F.col("orderkey"), "left").where(
        F.col("gone_in").isNull() | (F.col("stream") > F.col("gone_in"))
    )
    first = later.groupBy("key").agg(F.min("stream").alias("since"))
    taken = old_orders.join(first, F.col("o_orderkey") == F.col("key"), "left_semi").select(F.col("o_orderkey").alias("taken"))
    won = first.join(taken, F.col("key") == F.col("taken"), "left_anti")

    def of(rows: DataFrame, key: str, like: DataFrame) -> DataFrame:
        own = rows.join(won, (F.col(key) == F.col("key")) & (F.col("stream") == F.col("since")), "left_semi")
        return own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])

    return (
        old_orders.unionByName(of(changes.orders, "o_orderkey", orders)),
        old_lines.unionByName(of(changes.lines, "l_orderkey", lines)),
    )


def key_at(orders: DataFrame, rank: int) -> int | None:
    """The order key with ``rank`` smaller ones, or None if there are not so many.

    Keys are counted in a thousand ranges, then in the range that holds the rank, until it is one
    key wide. No sort, and a thousand counts at a time reach the driver.
    """
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    while low is not None:
        width = (high - low) // RANGES + 1
        place = F.floor((F.col("o_orderkey") - low) / width).cast("bigint")
        inside = orders.where(F.col("o_orderkey").between(low, high))
        counts = dict(inside.groupBy(place).count().collect())
        for i in sorted(counts):
            if rank < counts[i]:
                break
            rank -= counts[i]
        else:
            return None
        if width == 1:
            return low + i
        low, high = low + i * width, min(high, low + (i + 1) * width - 1)
    return None


def refresh_keys(orders: DataFrame, stream: int = 1) -> DataFrame:
    """(orderkey): what refresh ``stream``, counted from 1, deletes: the next thousandth by rank."""
    size = -(-orders.count() // REFRESH_SHARE)
    first, end = key_at(orders, size * (stream - 1)), key_at(orders, size * stream)
    key = F.col("o_orderkey")
    chosen = F.lit(False) if first is None else key >= first
    if end is not None:
        chosen = chosen & (key < end)
    return orders.where(chosen).select(key.alias("orderkey"))


def refresh_rows(
    orders: DataFrame, lines: DataFrame, stream: int = 1
) -> tuple[DataFrame, DataFrame]:
    """New orders and lines of refresh ``stream``: copies of its range under unused keys."""
    keys = refresh_keys(orders, stream)
    shift = orders.agg(F.max("o_orderkey") + 1).scalar()
    picked = orders.join(keys, F.col("o_orderkey") == F.col("orderkey"), "left_semi")
    with_lines = lines.join(keys, F.col("l_orderkey") == F.col("orderkey"), "left_semi")
    return (
        picked.withColumn("o_orderkey", F.col("o_orderkey") + shift),
        with_lines.withColumn("l_orderkey", F.col("l_orderkey") + shift),
    )


def orders_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Every order with each of its lines; an order without lines has nulls."""
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )


def order_rollup(lines: DataFrame, unit: float = 100.0) -> DataFrame:
    """Total price and status per order, cents cut off after discount and after tax."""
    net = F.floor(F.col("l_extendedprice") * (100 - F.col("l_discount")) / 100)
    gross = F.floor(net * (100 + F.col("l_tax")) / 100)
    done = F.count_if(F.col("l_linestatus") == "F")
    return lines.groupBy("l_orderkey").agg(
        (exact_sum(gross).cast("double") / unit).alias("o_totalprice"),
        F.when(done == F.count("*"), "F").when(done > 0, "P").otherwise("O").alias("o_orderstatus"),
    )


def line_status(lines: DataFrame, today: date = CURRENT_DAY) -> DataFrame:
    """Lines with flag and status as of ``today``: not yet received, not yet shipped."""
    day = F.lit(today)
    return lines.withColumns(
        {
            "l_returnflag": F.when(F.col("l_receiptdate") > day, "N").otherwise(
                F.col("l_returnflag")
            ),
            "l_linestatus": F.when(F.col("l_shipdate") <= day, "F").otherwise("O"),
        }
    )


def retail_price(key: Column) -> Column:
    """List price in cents, from the part key alone."""
    return 90000 + F.floor(key / 10) % 20001 + (key % 1000) * 100


def part_supplier_bridge(parts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(partkey, suppkey): the four suppliers of every part, spread over all suppliers."""
    rows = parts.select(
        F.col("p_partkey").alias("partkey"),
        F.explode(F.sequence(F.lit(0), F.lit(SUPPLIERS_PER_PART - 1))).alias("slot"),
        suppliers.agg(F.count("*")).scalar().alias("suppliers"),
    )
    return rows.selectExpr(
        "partkey",
        f"(partkey + slot * (suppliers div {SUPPLIERS_PER_PART} + (partkey - 1) div suppliers))"
        " % suppliers + 1 AS suppkey",
    )


def sparse_key(index: Column, sequence: int) -> Column:
    """An order key that keeps the low bits of ``index`` and leaves room for a sequence."""
    high = F.shiftleft(F.shiftright(index, KEEP_BITS), SEQUENCE_BITS) + sequence
    return F.shiftleft(high, KEEP_BITS) + index.bitwiseAND(F.lit((1 << KEEP_BITS) - 1))


def country_codes(customers: DataFrame) -> DataFrame:
    """(c_custkey, country_code): the first part of a phone number."""
    return customers.select("c_custkey", country_code(F.col("c_nationkey")).alias("country_code"))


def date_dim(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per day from the first order to the last shipment."""
    days = orders.agg(F.min("o_orderdate").cast("date").alias("first")).select(
        F.explode(
            F.sequence("first", lines.agg(F.max("l_shipdate").cast("date")).scalar())
        ).alias("day")
    )
    return days.select(
        F.datediff("day", F.lit(date(1970, 1, 1))).cast("bigint").alias("timekey"),
        "day",
        F.year("day").cast("int").alias("year"),
        (F.month("day") + 12 * (F.year("day") - 1970)).cast("int").alias("month"),
        (F.floor((F.dayofyear("day") + FIRST_WEEKDAY - 1) / 7) + 1).cast("int").alias("week"),
        F.dayofmonth("day").cast("int").alias("day_of_month"),
    )
