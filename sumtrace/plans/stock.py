"""Queries over parts and their suppliers: q02, q09, q11, q16."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.amounts import profit, year_of
from sumtrace.functions.exact import exact_sum, resum, split_sums, total
from sumtrace.plans.lineitems import optional
from sumtrace.plans.orders import _nations, _nations_of, _suppliers

col = F.col


def _offers(t, parts: DataFrame) -> DataFrame:
    """Stock rows of some parts; as a semi-join this goes below a derived table's DISTINCT."""
    wanted = parts.select("p_partkey")
    return t.partsupp.join(wanted, col("ps_partkey") == col("p_partkey"), "left_semi")


def q02(t, p) -> DataFrame:
    """Cheapest suppliers of a region for parts of one size and type, first hundred."""
    parts = t.part.where(
        (col("p_size") == p.size) & col("p_type").endswith(p.type_suffix)
    ).select("p_partkey", "p_mfgr")
    sellers = t.supplier.join(_nations_of(t, p.region), col("s_nationkey") == col("n_nationkey"))
    offers = (
        _offers(t, parts)
        .join(parts, col("ps_partkey") == col("p_partkey"))
        .join(sellers, col("ps_suppkey") == col("s_suppkey"))
    )
    cheapest = offers.groupBy(col("p_partkey").alias("part")).agg(
        F.min("ps_supplycost").alias("least")
    )
    return (
        offers.join(
            cheapest, (col("p_partkey") == col("part")) & (col("ps_supplycost") == col("least"))
        )
        .select(
            (col("s_acctbal") / t.unit(2)).alias("s_acctbal"),
            "s_name",
            "n_name",
            "p_partkey",
            "p_mfgr",
            *optional(t.supplier, "s_address", "s_phone", "s_comment"),
        )
        .orderBy(col("s_acctbal").desc(), "n_name", "s_name", "p_partkey")
        .limit(100)
    )


def q09_rows(t, p) -> DataFrame:
    parts = t.part.where(col("p_name").contains(p.color)).select("p_partkey")
    orders = t.orders.select("o_orderkey", year_of("o_orderdate").alias("o_year"))
    return (
        t.lineitem.join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(
            _offers(t, parts),
            (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey")),
        )
        .join(
            _suppliers(t, t.nation.select("n_nationkey", "n_name")),
            col("l_suppkey") == col("s_suppkey"),
        )
        .join(orders, col("l_orderkey") == col("o_orderkey"))
        .withColumnRenamed("n_name", "nation")
    )


def q09(t, p) -> DataFrame:
    """Profit on parts of one colour per nation and year."""
    gain = exact_sum(profit()).cast("double") / t.unit(4)
    return (
        q09_rows(t, p)
        .groupBy("nation", "o_year")
        .agg(gain.alias("sum_profit"))
        .orderBy("nation", col("o_year").desc())
    )


def q11_rows(t, p) -> DataFrame:
    sellers = _suppliers(t, _nations(t, p.nation))
    return t.partsupp.join(sellers, col("ps_suppkey") == col("s_suppkey"), "left_semi")


def q11(t, p) -> DataFrame:
    """Parts whose stock value exceeds a fraction of the nation's, with that total."""
    per_part = (
        q11_rows(t, p)
        .groupBy("ps_partkey")
        .agg(*split_sums(col("ps_supplycost") * col("ps_availqty"), "v"))
    )
    whole = per_part.agg(*resum("v")).select(total("v")).scalar()
    share = Fraction(p.fraction)
    return (
        per_part.select("ps_partkey", total("v").alias("v"), whole.alias("whole"))
        .where(col("v") * share.denominator > col("whole") * share.numerator)
        .select(
            "ps_partkey",
            (col("v").cast("double") / t.unit(2)).alias("value"),
            (col("whole").cast("double") / t.unit(2)).alias("total_value"),
        )
        .orderBy(col("value").desc(), "ps_partkey")
    )


def q16(t, p) -> DataFrame:
    """Number of suppliers without complaints per brand, type and size."""
    parts = t.part.where(
        (col("p_brand") != p.brand)
        & ~col("p_type").startswith(p.type_prefix)
        & col("p_size").isin(*p.sizes)
    ).select("p_partkey", "p_brand", "p_type", "p_size")
    sellers = t.supplier.where(~col("s_comment").like("%Customer%Complaints%"))
    groups = ["p_brand", "p_type", "p_size"]
    return (
        _offers(t, parts)
        .join(parts, col("ps_partkey") == col("p_partkey"))
        .select(*groups, "ps_suppkey")
        .distinct()
        .join(sellers, col("ps_suppkey") == col("s_suppkey"), "left_semi")
        .groupBy(*groups)
        .agg(F.count("*").alias("supplier_cnt"))
        .orderBy(col("supplier_cnt").desc(), *groups)
    )
