"""The 22 queries with the parameters for the small test tables."""

from __future__ import annotations

from sqlcheck.base import ctes

_Q12 = """SELECT l_shipmode, CAST(SUM(high) AS BIGINT) AS high_line_count,
        CAST(SUM(1 - high) AS BIGINT) AS low_line_count
    FROM (SELECT shipmode AS l_shipmode,
            CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS high
          FROM li JOIN orders ON l_orderkey = o_orderkey
          WHERE shipmode IN ('MAIL','SHIP') AND commitdate < receiptdate AND l_shipdate < commitdate
            AND receiptdate >= DATE '1996-01-01' AND receiptdate < DATE '1997-01-01')
    GROUP BY 1 ORDER BY 1"""

ANSWERS = {
    "q01": ctes("li") + """
        SELECT l_returnflag, l_linestatus,
            CAST(SUM(qty) AS DOUBLE) AS sum_qty, CAST(SUM(price) AS DOUBLE) AS sum_base_price,
            CAST(SUM(rev) AS DOUBLE) AS sum_disc_price,
            CAST(SUM(price * (1 - disc) * (1 + tax)) AS DOUBLE) AS sum_charge,
            CAST(SUM(qty) AS DOUBLE) / COUNT(*) AS avg_qty,
            CAST(SUM(price) AS DOUBLE) / COUNT(*) AS avg_price,
            CAST(SUM(disc) AS DOUBLE) / COUNT(*) AS avg_disc,
            COUNT(*) AS count_order
        FROM li WHERE l_shipdate <= DATE '2001-09-02' GROUP BY 1, 2 ORDER BY 1, 2""",
    "q02": ctes("ps", "pt", offers="""
            SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, supplycost
            FROM ps JOIN pt ON ps_partkey = p_partkey
            JOIN supplier ON ps_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            WHERE r_name = 'EUROPE' AND p_size = 15 AND p_type LIKE '%MEDIUM'""") + """
        SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_comment
        FROM offers o JOIN (SELECT s_name AS sn,
            CASE WHEN s_suppkey % 20 = 0 THEN 'x Customer y Complaints' ELSE 'ok' END AS s_comment
            FROM supplier) c ON o.s_name = c.sn
        WHERE supplycost = (SELECT MIN(supplycost) FROM offers i WHERE i.p_partkey = o.p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03": ctes("li") + """
        SELECT l_orderkey, CAST(SUM(rev) AS DOUBLE) AS revenue,
            CAST(o_orderdate AS DATE) AS o_orderdate, 0 AS o_shippriority
        FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15'
          AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate
        ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": ctes("li") + """
        SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
          AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND commitdate < receiptdate)
        GROUP BY 1 ORDER BY 1""",
    "q05": ctes("li") + """
        SELECT n_name, CAST(SUM(rev) AS DOUBLE) AS revenue
        FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
        GROUP BY 1 ORDER BY 2 DESC""",
    "q06": ctes("li") + """
        SELECT CAST(SUM(price * disc) AS DOUBLE) AS revenue FROM li
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
          AND disc BETWEEN 0.05 AND 0.07 AND qty < 24""",
    "q07": ctes("li") + """
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation,
            CAST(year(l_shipdate) AS INTEGER) AS l_year, CAST(SUM(rev) AS DOUBLE) AS revenue
        FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7')
            OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
          AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
        GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""",
    "q08": ctes("li", s="""
            SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year,
                CAST(SUM(CASE WHEN n2.n_name = 'NATION_6' THEN rev ELSE 0 END) AS DOUBLE) AS nation_volume,
                CAST(SUM(rev) AS DOUBLE) AS total_volume
            FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
            JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
            JOIN nation n2 ON s_nationkey = n2.n_nationkey
            WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY'
              AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
            GROUP BY 1""") + """
        SELECT *, nation_volume / total_volume AS mkt_share FROM s ORDER BY o_year""",
    "q09": ctes("li", "ps") + """
        SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year,
            CAST(SUM(rev - supplycost * qty) AS DOUBLE) AS sum_profit
        FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
        JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE p_name LIKE '%blue%' GROUP BY 1, 2 ORDER BY 1, 2 DESC""",
    "q10": ctes("li", "cu") + """
        SELECT c_custkey, c_name, CAST(SUM(rev) AS DOUBLE) AS revenue, c_acctbal, n_name, c_phone
        FROM li JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
          AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name, c_phone
        ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": ctes("ps", v="""
            SELECT ps_partkey, SUM(supplycost * availqty) AS v
            FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            WHERE n_name = 'NATION_7' GROUP BY 1""") + """
        SELECT ps_partkey, CAST(v AS DOUBLE) AS value,
            CAST((SELECT SUM(v) FROM v) AS DOUBLE) AS total_value
        FROM v WHERE v * 1000 > (SELECT SUM(v) FROM v) ORDER BY value DESC""",
    "q12": ctes("li") + _Q12,
    "q13": ctes("od") + """
        SELECT c_count, COUNT(*) AS custdist
        FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count
              FROM customer LEFT JOIN od ON c_custkey = o_custkey
                AND o_comment NOT LIKE '%special%requests%'
              GROUP BY 1)
        GROUP BY 1 ORDER BY 2 DESC, 1 DESC""",
    "q14": ctes("li", s="""
            SELECT CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN rev ELSE 0 END) AS DOUBLE) AS promo_value,
                CAST(SUM(rev) AS DOUBLE) AS total_value
            FROM li JOIN part ON l_partkey = p_partkey
            WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-02-01'""") + """
        SELECT *, promo_value * 100 / total_value AS promo_revenue FROM s""",
    "q15": ctes("li", r="""
            SELECT l_suppkey, SUM(rev) AS total FROM li
            WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'
            GROUP BY 1""") + """
        SELECT s_suppkey, s_name, CAST(total AS DOUBLE) AS total_revenue
        FROM r JOIN supplier ON l_suppkey = s_suppkey
        WHERE total = (SELECT MAX(total) FROM r) ORDER BY 1""",
    "q16": ctes("ps", "su") + """
        SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt
        FROM ps JOIN part ON ps_partkey = p_partkey
        WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%'
          AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM su WHERE s_comment LIKE '%Customer%Complaints%')
        GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3""",
    "q17": ctes("li", "pt", m="SELECT l_partkey AS pk, SUM(qty) AS sq, COUNT(*) AS n FROM li GROUP BY 1") + """
        SELECT CAST(SUM(price) AS DOUBLE) / 7 AS avg_yearly
        FROM li JOIN pt ON l_partkey = p_partkey JOIN m ON l_partkey = pk
        WHERE p_brand = 'Brand#23' AND p_container IN ('MED CASE','MED BOX','MED BAG','MED JAR','MED PKG','MED PACK','MED CAN','MED DRUM') AND qty * 5 * n < sq""",
    "q18": ctes("li") + """
        SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
            CAST(SUM(qty) AS DOUBLE) AS sum_quantity
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN li ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM li GROUP BY 1 HAVING SUM(qty) > 300)
        GROUP BY 1, 2, 3, 4, 5 ORDER BY o_totalprice DESC, 4, 3 LIMIT 100""",
    "q19": ctes("li", "pt") + """
        SELECT CAST(SUM(rev) AS DOUBLE) AS revenue FROM li JOIN pt ON l_partkey = p_partkey
        WHERE shipmode IN ('AIR','REG AIR') AND instruct = 'DELIVER IN PERSON' AND (
            (p_brand = 'Brand#12' AND p_container IN ('SM CASE','SM BOX','SM PACK','SM PKG')
             AND qty BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
         OR (p_brand = 'Brand#23' AND p_container IN ('MED BAG','MED BOX','MED PKG','MED PACK')
             AND qty BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
         OR (p_brand = 'Brand#14' AND p_container IN ('LG CASE','LG BOX','LG PACK','LG PKG')
             AND qty BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
    "q20": ctes("li", "ps") + """
        SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name = 'NATION_3' AND s_suppkey IN (
            SELECT ps_suppkey FROM ps
            WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
              AND availqty > (SELECT 0.5 * SUM(qty) FROM li
                  WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
                    AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))
        ORDER BY s_name""",
    "q20_shipped": ctes("li") + """
        SELECT l_partkey, l_suppkey, CAST(SUM(qty) AS DOUBLE) AS sum_quantity FROM li
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1, 2""",
    "q21": ctes("li") + """
        SELECT s_name, COUNT(*) AS numwait
        FROM li l1 JOIN supplier ON l1.l_suppkey = s_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
        JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND receiptdate > commitdate AND n_name = 'NATION_20'
          AND EXISTS (SELECT 1 FROM li l2 WHERE l2.l_orderkey = l1.l_orderkey
                      AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM li l3 WHERE l3.l_orderkey = l1.l_orderkey
                      AND l3.l_suppkey <> l1.l_suppkey AND l3.receiptdate > l3.commitdate)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "q22": ctes("cu", f="""SELECT *, substring(c_phone, 1, 2) AS cntrycode FROM cu
            WHERE substring(c_phone, 1, 2) IN ('13','31','23','29','30','18','17')""") + """
        SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(bal) AS DOUBLE) AS totacctbal FROM f
        WHERE bal > (SELECT AVG(bal) FROM f WHERE bal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                          AND o_orderdate >= DATE '2000-06-01')
        GROUP BY 1 ORDER BY 1""",
}
for _q in ("q08", "q12", "q13", "q14", "q15"):
    ANSWERS[f"{_q}_sql"] = ANSWERS[_q]
