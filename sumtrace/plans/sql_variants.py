"""Five queries once more as SQL text with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sumtrace.plans.params import plus_months

_REVENUE = "l_extendedprice * (100 - l_discount)"


def _run(t, text: str, args: dict, *names: str) -> DataFrame:
    return t.spark.sql(text, args=args, **{n: getattr(t, n) for n in names})


def q08_sql(t, p) -> DataFrame:
    text = f"""
        WITH all_nations AS (
            SELECT YEAR(o_orderdate) AS o_year, n2.n_name AS nation,
                   CAST({_REVENUE} AS DECIMAL(20,0)) AS volume
            FROM {{lineitem}}
            JOIN {{part}} ON p_partkey = l_partkey
            JOIN {{supplier}} ON s_suppkey = l_suppkey
            JOIN {{orders}} ON o_orderkey = l_orderkey
            JOIN {{customer}} ON c_custkey = o_custkey
            JOIN {{nation}} n1 ON n1.n_nationkey = c_nationkey
            JOIN {{region}} ON r_regionkey = n1.n_regionkey
            JOIN {{nation}} n2 ON n2.n_nationkey = s_nationkey
            WHERE r_name = :region AND p_type = :type
              AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'),
        sums AS (
            SELECT o_year, SUM(CASE WHEN nation = :nation THEN volume ELSE 0 END) AS own,
                   SUM(volume) AS whole
            FROM all_nations GROUP BY o_year)
        SELECT o_year,
               CAST(own AS DOUBLE) / {t.unit(4)} AS nation_volume,
               CAST(whole AS DOUBLE) / {t.unit(4)} AS total_volume,
               try_divide(CAST(own AS DOUBLE) / {t.unit(4)}, CAST(whole AS DOUBLE) / {t.unit(4)})
                   AS mkt_share
        FROM sums ORDER BY o_year"""
    return _run(
        t, text, vars(p), "lineitem", "part", "supplier", "orders", "customer", "nation", "region"
    )


def q12_sql(t, p) -> DataFrame:
    text = """
        SELECT l_shipmode,
               SUM(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 ELSE 0 END)
                   AS high_line_count,
               SUM(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 ELSE 1 END)
                   AS low_line_count
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
        WHERE l_shipmode IN (:mode_1, :mode_2)
          AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
          AND l_receiptdate >= :start AND l_receiptdate < :stop
        GROUP BY l_shipmode ORDER BY l_shipmode"""
    return _run(t, text, vars(p) | {"stop": plus_months(p.start, 12)}, "orders", "lineitem")


def q13_sql(t, p) -> DataFrame:
    text = """
        WITH orders_per_customer AS (
            SELECT c_custkey, COUNT(o_orderkey) AS c_count
            FROM {customer} LEFT JOIN {orders}
              ON c_custkey = o_custkey AND o_comment NOT LIKE :pattern
            GROUP BY c_custkey)
        SELECT c_count, COUNT(*) AS custdist FROM orders_per_customer
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC"""
    return _run(t, text, {"pattern": f"%{p.word_1}%{p.word_2}%"}, "customer", "orders")


def q14_sql(t, p) -> DataFrame:
    text = f"""
        WITH sums AS (
            SELECT SUM(CASE WHEN SUBSTRING(p_type FROM 1 FOR 5) = 'PROMO'
                            THEN CAST({_REVENUE} AS DECIMAL(20,0)) ELSE 0 END) AS promo,
                   SUM(CAST({_REVENUE} AS DECIMAL(20,0))) AS whole
            FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
            WHERE l_shipdate >= :start AND l_shipdate < :stop)
        SELECT CAST(promo AS DOUBLE) / {t.unit(4)} AS promo_value,
               CAST(whole AS DOUBLE) / {t.unit(4)} AS total_value,
               try_divide(CAST(promo AS DOUBLE) / {t.unit(4)} * 100,
                          CAST(whole AS DOUBLE) / {t.unit(4)}) AS promo_revenue
        FROM sums"""
    return _run(t, text, vars(p) | {"stop": plus_months(p.start, 1)}, "lineitem", "part")


def q15_sql(t, p) -> DataFrame:
    name = ", s_name" if "s_name" in t.supplier.columns else ""
    text = f"""
        WITH revenue AS (
            SELECT l_suppkey AS supplier_no, SUM(CAST({_REVENUE} AS DECIMAL(20,0))) AS total
            FROM {{lineitem}}
            WHERE l_shipdate >= :start AND l_shipdate < :stop
            GROUP BY l_suppkey)
        SELECT s_suppkey{name}, CAST(total AS DOUBLE) / {t.unit(4)} AS total_revenue
        FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no
        WHERE total = (SELECT MAX(total) FROM revenue)
        ORDER BY s_suppkey"""
    return _run(t, text, vars(p) | {"stop": plus_months(p.start, 3)}, "lineitem", "supplier")
