"""Queries that read mostly line items: q01, q06, q14, q15, q17, q19, q20.

Lines are summed per part before they meet parts where the part is all they are
grouped by (q14): a part that holds a large share of all lines reaches the join as
one row, and the join reuses the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumtrace.functions.amounts import charge, disc_price
from sumtrace.functions.exact import exact_sum, resum, split_sums, total
from sumtrace.plans.params import plus_months

col, lit = F.col, F.lit


def between(name: str, start: date, months: int):
    return (col(name) >= lit(start)) & (col(name) < lit(plus_months(start, months)))


def optional(df: DataFrame, *names: str) -> list[str]:
    """Those of the named columns that the table has."""
    return [n for n in names if n in df.columns]


def q01_rows(t, p) -> DataFrame:
    return t.lineitem.where(col("l_shipdate") <= lit(p.cutoff))


def q01(t, p) -> DataFrame:
    """Pricing summary per return flag and line status."""
    n = F.count("l_quantity")
    qty = exact_sum(col("l_quantity")).cast("double")
    price = exact_sum(col("l_extendedprice")).cast("double")
    disc = exact_sum(col("l_discount")).cast("double")
    return (
        q01_rows(t, p)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            qty.alias("sum_qty"),
            (price / t.unit(2)).alias("sum_base_price"),
            (exact_sum(disc_price()).cast("double") / t.unit(4)).alias("sum_disc_price"),
            (exact_sum(charge()).cast("double") / t.unit(6)).alias("sum_charge"),
            (qty / n).alias("avg_qty"),
            (price / t.unit(2) / n).alias("avg_price"),
            (disc / t.unit(2) / n).alias("avg_disc"),
            n.alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q06_rows(t, p) -> DataFrame:
    lines = t.rows(
        "lineitem",
        l_discount=(p.discount - 1, p.discount + 1),
        l_quantity=(None, p.quantity - 1),
    )
    return lines.where(between("l_shipdate", p.start, 12))


def q06(t, p) -> DataFrame:
    """Revenue gained had small discounts of one year not been given."""
    amount = exact_sum(col("l_extendedprice") * col("l_discount"))
    return q06_rows(t, p).agg((amount.cast("double") / t.unit(4)).alias("revenue"))


def q14_rows(t, p) -> DataFrame:
    return (
        t.lineitem.where(between("l_shipdate", p.start, 1))
        .join(t.part.select("p_partkey", "p_type"), col("l_partkey") == col("p_partkey"))
        .withColumn("is_promo", col("p_type").startswith("PROMO"))
    )


def q14(t, p) -> DataFrame:
    """Share of promotion parts in one month's revenue, in percent, with both sums."""
    per_part = (
        t.lineitem.where(between("l_shipdate", p.start, 1))
        .groupBy("l_partkey")
        .agg(*split_sums(disc_price(), "rev"))
    )
    sums = per_part.join(
        t.part.select("p_partkey", "p_type"), col("l_partkey") == col("p_partkey")
    ).agg(
        *resum("rev"),
        *[
            c.alias(f"promo_{side}")
            for c, side in zip(resum("rev", col("p_type").startswith("PROMO")), ("hi", "lo"))
        ],
    )
    return sums.select(
        (total("promo").cast("double") / t.unit(4)).alias("promo_value"),
        (total("rev").cast("double") / t.unit(4)).alias("total_value"),
    ).select(
        "promo_value",
        "total_value",
        F.try_divide(col("promo_value") * 100, col("total_value")).alias("promo_revenue"),
    )


def q15_rows(t, p) -> DataFrame:
    return t.lineitem.where(between("l_shipdate", p.start, 3))


def q15(t, p) -> DataFrame:
    """Supplier or suppliers with the highest revenue of a quarter."""
    revenue = (
        q15_rows(t, p)
        .groupBy("l_suppkey")
        .agg(*split_sums(disc_price(), "rev"))
        .select("l_suppkey", total("rev").alias("total"))
    )
    s = t.supplier
    return (
        revenue.where(col("total") == revenue.agg(F.max("total")).scalar())
        .join(s, col("l_suppkey") == col("s_suppkey"))
        .select(
            "s_suppkey",
            *optional(s, "s_name", "s_address", "s_phone"),
            (col("total").cast("double") / t.unit(4)).alias("total_revenue"),
        )
        .orderBy("s_suppkey")
    )


def _q17_parts(t, p) -> DataFrame:
    wanted = (col("p_brand") == p.brand) & col("p_container").isin(*p.containers)
    return t.part.where(wanted).select("p_partkey")


def _q17_small():
    """quantity < 0.2 * part_qty / part_n, in whole numbers."""
    return col("l_quantity") * 5 * col("part_n") < col("part_qty")


def _q17_lines(t, p) -> DataFrame:
    parts = _q17_parts(t, p)
    return t.lineitem.join(parts, col("l_partkey") == col("p_partkey"), "left_semi")


def _q17_sums(t, p) -> DataFrame:
    """Lines of the wanted parts summed per (part, quantity).

    Grouping by a struct keeps this from reusing the join's partitioning by part
    alone, so a part with very many lines is split by the join and combined map-side.
    """
    return (
        _q17_lines(t, p)
        .groupBy(F.struct("l_partkey", "l_quantity").alias("k"))
        .agg(F.count("*").alias("n"), *split_sums(col("l_extendedprice"), "price"))
        .select("k.l_partkey", "k.l_quantity", "n", "price_hi", "price_lo")
    )


def q17_rows(t, p) -> DataFrame:
    means = (
        _q17_sums(t, p)
        .groupBy(col("l_partkey").alias("part"))
        .agg(F.sum("n").alias("part_n"), F.sum(col("n") * col("l_quantity")).alias("part_qty"))
    )
    return _q17_lines(t, p).join(means, col("l_partkey") == col("part")).where(_q17_small())


def q17(t, p) -> DataFrame:
    """Average yearly revenue of lines far below their part's mean quantity.

    The window runs over one row per part and quantity, so a part has at most as
    many rows as there are quantities.
    """
    of_part = Window.partitionBy("l_partkey")
    return (
        _q17_sums(t, p)
        .withColumns(
            {
                "part_n": F.sum("n").over(of_part),
                "part_qty": F.sum(col("n") * col("l_quantity")).over(of_part),
            }
        )
        .where(_q17_small())
        .agg(*resum("price"))
        .select((total("price").cast("double") / t.unit(2) / 7).alias("avg_yearly"))
    )


# Containers per branch.
_SMALL_BOXES = ["SM CASE", "SM BOX", "SM PACK", "SM PKG"]
_MEDIUM_BOXES = ["MED BAG", "MED BOX", "MED PKG", "MED PACK"]
_LARGE_BOXES = ["LG CASE", "LG BOX", "LG PACK", "LG PKG"]


def _q19_match(p):
    branches = None
    for brand, low, boxes, size in zip(
        p.brands, p.quantities, (_SMALL_BOXES, _MEDIUM_BOXES, _LARGE_BOXES), (5, 10, 15)
    ):
        branch = (
            (col("p_brand") == brand)
            & col("p_container").isin(boxes)
            & col("l_quantity").between(low, low + 10)
            & col("p_size").between(1, size)
        )
        branches = branch if branches is None else branches | branch
    return branches


def _q19_lines(t, p) -> DataFrame:
    # the widest of the branches' ranges, for the scan
    return t.rows("lineitem", l_quantity=(min(p.quantities), max(p.quantities) + 10)).where(
        col("l_shipmode").isin("AIR", "REG AIR")
        & (col("l_shipinstruct") == "DELIVER IN PERSON")
    )


def q19_rows(t, p) -> DataFrame:
    return _q19_lines(t, p).join(t.part, (col("l_partkey") == col("p_partkey")) & _q19_match(p))


def q19(t, p) -> DataFrame:
    """Revenue of hand-delivered air lines in three brand, box and quantity branches."""
    amount = exact_sum(disc_price())
    return q19_rows(t, p).agg((amount.cast("double") / t.unit(4)).alias("revenue"))


def q20_rows(t, p) -> DataFrame:
    return t.lineitem.where(between("l_shipdate", p.start, 12))


def _q20_sums(t, p) -> DataFrame:
    return (
        q20_rows(t, p).groupBy("l_partkey", "l_suppkey").agg(*split_sums(col("l_quantity"), "qty"))
    )


def q20_shipped(t, p) -> DataFrame:
    """Quantity shipped in the year per part and supplier."""
    return _q20_sums(t, p).select(
        "l_partkey", "l_suppkey", total("qty").cast("double").alias("sum_quantity")
    )


def q20(t, p) -> DataFrame:
    """Suppliers of a nation that hold more than half a year's shipments of some part."""
    parts = t.part.where(col("p_name").startswith(p.color)).select("p_partkey")
    home = t.nation.where(col("n_name") == p.nation).select("n_nationkey")
    excess = (
        t.partsupp.join(
            _q20_sums(t, p),
            (col("ps_partkey") == col("l_partkey")) & (col("ps_suppkey") == col("l_suppkey")),
        )
        .where(col("ps_availqty") * 2 > total("qty"))
        .join(parts, col("ps_partkey") == col("p_partkey"), "left_semi")
        .select("ps_suppkey")
        .distinct()
    )
    s = t.supplier
    return (
        s.join(home, col("s_nationkey") == col("n_nationkey"), "left_semi")
        .join(excess, col("s_suppkey") == col("ps_suppkey"), "left_semi")
        .select("s_suppkey", *optional(s, "s_name", "s_address"))
        .orderBy("s_name", "s_suppkey")
    )
