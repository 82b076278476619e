"""Queries that join lines with orders and customers.

Where lines are only needed in sum per order (q03, q10, q13, q18, q21) they are
summed before the join. The shuffle is the one the join needs anyway, it is
combined map-side, and an order with very many lines reaches the join as one row.
Where lines are grouped by something else, summing first would cost a shuffle of
its own. There the join comes first: its output is shuffled again in any case, so
adaptive execution is free to split the partition of such an order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.amounts import day, disc_price, year_of
from sumtrace.functions.exact import exact_sum, resum, split_sums, total
from sumtrace.plans.lineitems import between, optional

col, lit = F.col, F.lit
TWO_YEARS = (date(1995, 1, 1), date(1996, 12, 31))


def _money(t, name: str, digits: int):
    return total(name).cast("double") / t.unit(digits)


def _revenue(t, amount=None):
    """Aggregate: the sum of discounted prices, or of another amount with four decimals."""
    amount = disc_price() if amount is None else amount
    return exact_sum(amount).cast("double") / t.unit(4)


def _nations(t, *names: str) -> DataFrame:
    return t.nation.where(col("n_name").isin(*names)).select("n_nationkey", "n_name")


def _nations_of(t, region: str) -> DataFrame:
    inside = t.region.where(col("r_name") == region)
    return t.nation.join(inside, col("n_regionkey") == col("r_regionkey"), "left_semi").select(
        "n_nationkey", "n_name"
    )


def _suppliers(t, nations: DataFrame) -> DataFrame:
    return t.supplier.join(nations, col("s_nationkey") == col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", "n_name"
    )


def _q03_lines(t, p) -> DataFrame:
    return t.lineitem.where(col("l_shipdate") > lit(p.day))


def q03_rows(t, p) -> DataFrame:
    return _q03_lines(t, p)


def q03(t, p) -> DataFrame:
    """Ten unshipped orders with the highest revenue."""
    buyers = t.customer.where(col("c_mktsegment") == p.segment).select("c_custkey")
    orders = t.orders.where(col("o_orderdate") < lit(p.day)).join(
        buyers, col("o_custkey") == col("c_custkey"), "left_semi"
    )
    sums = _q03_lines(t, p).groupBy("l_orderkey").agg(*split_sums(disc_price(), "rev"))
    return (
        sums.join(orders, col("l_orderkey") == col("o_orderkey"))
        .select(
            "l_orderkey",
            _money(t, "rev", 4).alias("revenue"),
            day("o_orderdate"),
            "o_shippriority",
        )
        .orderBy(col("revenue").desc(), "o_orderdate", "l_orderkey")
        .limit(10)
    )


def q04(t, p) -> DataFrame:
    """Orders of a quarter with a late line, per priority."""
    late = (
        t.lineitem.where(col("l_commitdate") < col("l_receiptdate"))
        .select("l_orderkey")
        .distinct()
    )
    return (
        t.orders.where(between("o_orderdate", p.start, 3))
        .join(late, col("o_orderkey") == col("l_orderkey"), "left_semi")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("order_count"))
        .orderBy("o_orderpriority")
    )


def q05_rows(t, p) -> DataFrame:
    inside = _nations_of(t, p.region)
    buyers = t.customer.join(inside, col("c_nationkey") == col("n_nationkey"), "left_semi")
    orders = (
        t.orders.where(between("o_orderdate", p.start, 12))
        .join(buyers, col("o_custkey") == col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    # few lines are left after the orders of one year and region
    return t.lineitem.join(orders, col("l_orderkey") == col("o_orderkey")).join(
        _suppliers(t, inside),
        (col("l_suppkey") == col("s_suppkey")) & (col("s_nationkey") == col("c_nationkey")),
    )


def q05(t, p) -> DataFrame:
    """Revenue per nation of one region between local customers and suppliers."""
    return (
        q05_rows(t, p)
        .groupBy("n_name")
        .agg(_revenue(t).alias("revenue"))
        .orderBy(col("revenue").desc(), "n_name")
    )


def _q07_orders(t, p) -> DataFrame:
    nations = _nations(t, p.nation_1, p.nation_2)
    buyers = t.customer.join(nations, col("c_nationkey") == col("n_nationkey")).select(
        "c_custkey", col("n_name").alias("cust_nation")
    )
    return t.orders.join(buyers, col("o_custkey") == col("c_custkey")).select(
        "o_orderkey", "cust_nation"
    )


def q07_rows(t, p) -> DataFrame:
    lines = t.lineitem.where(col("l_shipdate").between(lit(TWO_YEARS[0]), lit(TWO_YEARS[1])))
    sellers = _suppliers(t, _nations(t, p.nation_1, p.nation_2))
    return (
        lines.join(_q07_orders(t, p), col("l_orderkey") == col("o_orderkey"))
        .join(sellers, (col("l_suppkey") == col("s_suppkey")) & (col("n_name") != col("cust_nation")))
        .withColumns({"supp_nation": col("n_name"), "l_year": year_of("l_shipdate")})
        .drop("n_name")
    )


def q07(t, p) -> DataFrame:
    """Revenue shipped between two nations, per direction and year."""
    groups = ["supp_nation", "cust_nation", "l_year"]
    return q07_rows(t, p).groupBy(*groups).agg(_revenue(t).alias("revenue")).orderBy(*groups)


def _q08_lines(t, p) -> DataFrame:
    parts = t.part.where(col("p_type") == p.type).select("p_partkey")
    sellers = _suppliers(t, t.nation.select("n_nationkey", "n_name"))
    return (
        t.lineitem.join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(sellers, col("l_suppkey") == col("s_suppkey"))
        .withColumn("is_nation", col("n_name") == p.nation)
    )


def _q08_orders(t, p) -> DataFrame:
    buyers = t.customer.join(
        _nations_of(t, p.region), col("c_nationkey") == col("n_nationkey"), "left_semi"
    )
    return (
        t.orders.where(col("o_orderdate").between(lit(TWO_YEARS[0]), lit(TWO_YEARS[1])))
        .join(buyers, col("o_custkey") == col("c_custkey"), "left_semi")
        .select("o_orderkey", year_of("o_orderdate").alias("o_year"))
    )


def q08_rows(t, p) -> DataFrame:
    return _q08_lines(t, p).join(_q08_orders(t, p), col("l_orderkey") == col("o_orderkey"))


def q08(t, p) -> DataFrame:
    """A nation's share in a region's purchases of one part type, per year."""
    own = F.when(col("is_nation"), disc_price()).otherwise(0)
    return (
        q08_rows(t, p)
        .groupBy("o_year")
        .agg(_revenue(t, own).alias("nation_volume"), _revenue(t).alias("total_volume"))
        .withColumn("mkt_share", F.try_divide("nation_volume", "total_volume"))
        .orderBy("o_year")
    )


def _q10_orders(t, p) -> DataFrame:
    return t.orders.where(between("o_orderdate", p.start, 3)).select("o_orderkey", "o_custkey")


def q10_rows(t, p) -> DataFrame:
    return t.lineitem.where(col("l_returnflag") == "R").join(
        _q10_orders(t, p), col("l_orderkey") == col("o_orderkey")
    )


def q10(t, p) -> DataFrame:
    """Twenty customers with the highest returned revenue of a quarter."""
    per_order = (
        t.lineitem.where(col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(*split_sums(disc_price(), "rev"))
    )
    per_customer = (
        per_order.join(_q10_orders(t, p), col("l_orderkey") == col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(*resum("rev"))
    )
    c = t.customer
    return (
        per_customer.join(c, col("o_custkey") == col("c_custkey"))
        .join(t.nation, col("c_nationkey") == col("n_nationkey"))
        .select(
            "c_custkey",
            "c_name",
            _money(t, "rev", 4).alias("revenue"),
            (col("c_acctbal") / t.unit(2)).alias("c_acctbal"),
            "n_name",
            *optional(c, "c_address", "c_phone", "c_comment"),
        )
        .orderBy(col("revenue").desc(), "c_custkey")
        .limit(20)
    )


def q12(t, p) -> DataFrame:
    """Late lines of two ship modes by high and low order priority."""
    lines = t.lineitem.where(
        col("l_shipmode").isin(p.mode_1, p.mode_2)
        & (col("l_commitdate") < col("l_receiptdate"))
        & (col("l_shipdate") < col("l_commitdate"))
        & between("l_receiptdate", p.start, 12)
    )
    high = col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        lines.join(t.orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_shipmode")
        .agg(
            F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"),
            F.sum(F.when(high, 0).otherwise(1)).alias("low_line_count"),
        )
        .orderBy("l_shipmode")
    )


def q13(t, p) -> DataFrame:
    """How many customers have how many orders; order-less customers count as 0."""
    per_customer = (
        t.orders.where(~col("o_comment").like(f"%{p.word_1}%{p.word_2}%"))
        .groupBy("o_custkey")
        .agg(F.count("o_orderkey").alias("n"))
    )
    return (
        t.customer.join(per_customer, col("c_custkey") == col("o_custkey"), "left")
        .groupBy(F.coalesce("n", lit(0)).alias("c_count"))
        .agg(F.count("*").alias("custdist"))
        .orderBy(col("custdist").desc(), col("c_count").desc())
    )


def q18_rows(t, p) -> DataFrame:
    return t.lineitem


def q18(t, p) -> DataFrame:
    """Hundred large orders by total price."""
    large = (
        t.lineitem.groupBy("l_orderkey")
        .agg(*split_sums(col("l_quantity"), "qty"))
        .where(total("qty") > p.quantity)
    )
    return (
        large.join(t.orders, col("l_orderkey") == col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_name"), col("o_custkey") == col("c_custkey"))
        .select(
            "c_name",
            "c_custkey",
            "o_orderkey",
            day("o_orderdate"),
            (col("o_totalprice") / t.unit(2)).alias("o_totalprice"),
            total("qty").cast("double").alias("sum_quantity"),
        )
        .orderBy(col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
        .limit(100)
    )


def q21(t, p) -> DataFrame:
    """Hundred suppliers who alone kept finished multi-supplier orders waiting.

    Least and greatest supplier tell "more than one" and "exactly one" apart, so
    one aggregation per order replaces both self-joins and the distinct counts.
    """
    late = col("l_receiptdate") > col("l_commitdate")
    per_order = (
        t.lineitem.groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("first_supp"),
            F.max("l_suppkey").alias("last_supp"),
            F.min(F.when(late, col("l_suppkey"))).alias("first_late"),
            F.max(F.when(late, col("l_suppkey"))).alias("last_late"),
            F.count(F.when(late, 1)).alias("late_lines"),
        )
        .where((col("first_supp") < col("last_supp")) & (col("first_late") == col("last_late")))
    )
    finished = t.orders.where(col("o_orderstatus") == "F").select("o_orderkey")
    home = _nations(t, p.nation)
    return (
        per_order.join(finished, col("l_orderkey") == col("o_orderkey"), "left_semi")
        .groupBy("first_late")
        .agg(F.sum("late_lines").alias("late_lines"))
        .join(
            t.supplier.join(home, col("s_nationkey") == col("n_nationkey"), "left_semi"),
            col("first_late") == col("s_suppkey"),
        )
        .groupBy("s_name")
        .agg(F.sum("late_lines").alias("numwait"))
        .orderBy(col("numwait").desc(), "s_name")
        .limit(100)
    )


def q22_rows(t, p) -> DataFrame:
    """Customers of the given country codes, above the mean balance, without orders."""
    code = F.substring("c_phone", 1, 2)
    people = t.customer.withColumn("cntrycode", code).where(col("cntrycode").isin(*p.codes))
    mean = (
        t.rows("customer", c_acctbal=(1, None))
        .where(F.substring("c_phone", 1, 2).isin(*p.codes))
        .agg(F.struct(F.sum("c_acctbal").alias("sum"), F.count("*").alias("n")))
        .scalar()
    )
    recent = t.orders
    if p.orders_since is not None:
        recent = recent.where(col("o_orderdate") >= lit(p.orders_since))
    buyers = recent.select("o_custkey").distinct()
    # balance > sum / n, in whole numbers
    return people.where(
        col("c_acctbal").cast("decimal(20,0)") * mean["n"] > mean["sum"]
    ).join(buyers, col("c_custkey") == col("o_custkey"), "left_anti")


def q22(t, p) -> DataFrame:
    """Number and balance of well-off customers without orders, per country code."""
    return (
        q22_rows(t, p)
        .groupBy("cntrycode")
        .agg(F.count("*").alias("numcust"), *split_sums(col("c_acctbal"), "bal"))
        .select("cntrycode", "numcust", _money(t, "bal", 2).alias("totacctbal"))
        .orderBy("cntrycode")
    )
