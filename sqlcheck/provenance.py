"""Terms behind released values, written per query from its own row set."""

from __future__ import annotations

from sqlcheck.answers import ANSWERS
from sqlcheck.base import ctes

Q, E, D, T = ("x7", "line", "q"), ("x8", "line", "e"), ("x9", "line", "d"), ("x10", "line", "t")
AV, CO, BA = ("x3", "psrow", "availqty"), ("x4", "psrow", "cost_c"), ("x5", "c_custkey", "bal_c")

REV = ("1*x8*(100-x9)", [E, D], "e * (100 - d)")
SUM_Q = ("1*x7", [Q], "q")
SUM_E = ("1*x8", [E], "e")
STOCK = ("1*x4*x3", [CO, AV], "cost_c * availqty")


def fn(name: str, *keys: str) -> str:
    return "concat_ws('|', " + ", ".join([f"'{name}'", *keys]) + ")"


_SPLIT = """li JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey"""

# query: (base tables, rows, [(function name, (shape, operands, value), condition)])
ROWS = {
    "q01": (
        ["li"],
        "SELECT * FROM li WHERE l_shipdate <= DATE '2001-09-02'",
        [
            (fn(f"q01.{n}", "l_returnflag", "l_linestatus"), term, "true")
            for n, term in (
                ("sum_qty", SUM_Q),
                ("sum_base_price", SUM_E),
                ("sum_disc_price", REV),
                ("sum_charge", ("1*x8*(100-x9)*(100+x10)", [E, D, T], "e * (100 - d) * (100 + t)")),
                ("avg_qty", SUM_Q),
                ("avg_price", SUM_E),
                ("avg_disc", ("1*x9", [D], "d")),
            )
        ],
    ),
    "q03": (
        ["li"],
        """SELECT * FROM li WHERE l_shipdate > DATE '1998-03-15'
           AND l_orderkey IN (SELECT l_orderkey FROM a)""",
        [(fn("q03.revenue", "l_orderkey"), REV, "true")],
    ),
    "q05": (
        ["li"],
        f"""SELECT * FROM {_SPLIT} JOIN nation ON s_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
            WHERE s_nationkey = c_nationkey AND r_name = 'ASIA'
            AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'""",
        [(fn("q05.revenue", "n_name"), REV, "true")],
    ),
    "q06": (
        ["li"],
        """SELECT * FROM li WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
           AND d BETWEEN 5 AND 7 AND q < 24""",
        [(fn("q06.revenue"), ("1*x8*x9", [E, D], "e * d"), "true")],
    ),
    "q07": (
        ["li"],
        f"""SELECT line, e, d, n1.n_name AS sn, n2.n_name AS cn, year(l_shipdate) AS y
            FROM {_SPLIT} JOIN nation n1 ON s_nationkey = n1.n_nationkey
            JOIN nation n2 ON c_nationkey = n2.n_nationkey
            WHERE n1.n_name IN ('NATION_6','NATION_7') AND n2.n_name IN ('NATION_6','NATION_7')
            AND n1.n_name <> n2.n_name
            AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""",
        [(fn("q07.revenue", "sn", "cn", "y"), REV, "true")],
    ),
    "q08": (
        ["li"],
        f"""SELECT line, e, d, year(o_orderdate) AS y, n2.n_name = 'NATION_6' AS own
            FROM {_SPLIT} JOIN part ON l_partkey = p_partkey
            JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
            JOIN nation n2 ON s_nationkey = n2.n_nationkey
            WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY'
            AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""",
        [
            (fn("q08.nation_volume", "y"), REV, "own"),
            (fn("q08.total_volume", "y"), REV, "true"),
        ],
    ),
    "q09": (
        ["li", "ps"],
        f"""SELECT line, psrow, e, d, q, cost_c, n_name, year(o_orderdate) AS y
            FROM {_SPLIT} JOIN part ON l_partkey = p_partkey
            JOIN ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
            JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%blue%'""",
        [
            (fn("q09.sum_profit", "n_name", "y"), REV, "true"),
            (
                fn("q09.sum_profit", "n_name", "y"),
                ("-100*x4*x7", [CO, Q], "-100 * cost_c * q"),
                "true",
            ),
        ],
    ),
    "q10": (
        ["li", "cu"],
        """SELECT * FROM li JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
           AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
           AND o_custkey IN (SELECT c_custkey FROM a)""",
        [(fn("q10.revenue", "o_custkey"), REV, "true")],
    ),
    "q11": (
        ["ps"],
        """SELECT *, ps_partkey IN (SELECT ps_partkey FROM a) AS kept
           FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           WHERE n_name = 'NATION_7'""",
        [
            (fn("q11.value", "ps_partkey"), STOCK, "kept"),
            (fn("q11.total_value"), STOCK, "true"),
        ],
    ),
    "q14": (
        ["li"],
        """SELECT * FROM li JOIN part ON l_partkey = p_partkey
           WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-02-01'""",
        [
            (fn("q14.promo_value"), REV, "starts_with(p_type, 'PROMO')"),
            (fn("q14.total_value"), REV, "true"),
        ],
    ),
    "q15": (
        ["li"],
        """SELECT * FROM li WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'
           AND l_suppkey IN (SELECT s_suppkey FROM a)""",
        [(fn("q15.total_revenue", "l_suppkey"), REV, "true")],
    ),
    "q17": (
        ["li", "pt"],
        """SELECT * FROM li JOIN pt ON l_partkey = p_partkey
           JOIN (SELECT l_partkey AS pk, SUM(qty) AS sq, COUNT(*) AS n FROM li GROUP BY 1)
             ON l_partkey = pk
           WHERE p_brand = 'Brand#23' AND p_container IN ('MED CASE','MED BOX','MED BAG','MED JAR','MED PKG','MED PACK','MED CAN','MED DRUM') AND qty * 5 * n < sq""",
        [(fn("q17.avg_yearly"), SUM_E, "true")],
    ),
    "q18": (
        ["li"],
        "SELECT * FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM a)",
        [(fn("q18.sum_quantity", "l_orderkey"), SUM_Q, "true")],
    ),
    "q19": (
        ["li", "pt"],
        """SELECT * FROM li JOIN pt ON l_partkey = p_partkey
        WHERE shipmode IN ('AIR','REG AIR') AND instruct = 'DELIVER IN PERSON' AND (
            (p_brand = 'Brand#12' AND p_container IN ('SM CASE','SM BOX','SM PACK','SM PKG')
             AND q BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
         OR (p_brand = 'Brand#23' AND p_container IN ('MED BAG','MED BOX','MED PKG','MED PACK')
             AND q BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
         OR (p_brand = 'Brand#14' AND p_container IN ('LG CASE','LG BOX','LG PACK','LG PKG')
             AND q BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
        [(fn("q19.revenue"), REV, "true")],
    ),
    "q20_shipped": (
        ["li"],
        "SELECT * FROM li WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'",
        [(fn("q20_shipped.sum_quantity", "l_partkey", "l_suppkey"), SUM_Q, "true")],
    ),
    "q22": (
        ["cu"],
        """SELECT *, substring(c_phone, 1, 2) AS code FROM cu
           WHERE substring(c_phone, 1, 2) IN ('13','31','23','29','30','18','17')
           AND bal > (SELECT AVG(bal) FROM cu WHERE bal > 0
             AND substring(c_phone, 1, 2) IN ('13','31','23','29','30','18','17'))
           AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-06-01')""",
        [(fn("q22.totacctbal", "code"), ("1*x5", [BA], "bal_c"), "true")],
    ),
}


def _shift(shape: str, tag: str) -> tuple[int, int]:
    if f"(100-{tag})" in shape:
        return 100, -1
    if f"(100+{tag})" in shape:
        return 100, 1
    return 0, 1


def _select(function, term, condition) -> str:
    shape, ops, value = term
    cols = []
    for i in (1, 2, 3):
        if i <= len(ops):
            tag, row, x = ops[i - 1]
            shift, sign = _shift(shape, tag)
            cols.append(
                f"'{tag}_' || {row} AS var_{i}, CAST({x} AS DOUBLE) AS x_{i}, {shift} AS shift_{i}, {sign} AS sign_{i}"
            )
        else:
            cols.append(
                f"CAST(NULL AS VARCHAR) AS var_{i}, CAST(NULL AS DOUBLE) AS x_{i}, 0 AS shift_{i}, 1 AS sign_{i}"
            )
    row = ops[0][1] if "line" not in [o[1] for o in ops] else "line"
    coef = shape.split("*")[0]
    return (
        f"SELECT {function} AS fn, CAST({row} AS VARCHAR) AS \"row\", '{shape}' AS shape, "
        f"CAST({coef} AS DOUBLE) AS coef, {', '.join(cols)}, CAST({value} AS DOUBLE) AS value "
        f"FROM r WHERE {condition}"
    )


def term_query(query: str) -> str:
    """A self-contained query for all terms of one release."""
    tables, rows, outputs = ROWS[query]
    more = {"a": ANSWERS[query]} if "FROM a)" in rows else {}
    union = "\nUNION ALL ".join(_select(*o) for o in outputs)
    return ctes(*tables, **more, r=rows) + union


def all_terms(queries) -> str:
    """CTE body: the terms of several releases together."""
    return "\nUNION ALL ".join(f"SELECT * FROM ({term_query(q)})" for q in queries)


_LISTED = '"fn", "row", shape, var_1, x_1, var_2, x_2, var_3, x_3, value'

# query: (released columns as (name, key expressions, divisor))
_KEYS = {
    "q01": ["l_returnflag", "l_linestatus"],
    "q03": ["l_orderkey"],
    "q05": ["n_name"],
    "q07": ["supp_nation", "cust_nation", "l_year"],
    "q08": ["o_year"],
    "q09": ["nation", "o_year"],
    "q10": ["c_custkey"],
    "q11": ["ps_partkey"],
    "q15": ["s_suppkey"],
    "q18": ["o_orderkey"],
    "q20_shipped": ["l_partkey", "l_suppkey"],
    "q22": ["cntrycode"],
}
_RELEASED = {
    "q01": [
        ("sum_qty", 0, "1"), ("sum_base_price", 2, "1"), ("sum_disc_price", 4, "1"),
        ("sum_charge", 6, "1"), ("avg_qty", 0, "count_order"), ("avg_price", 2, "count_order"),
        ("avg_disc", 2, "count_order"),
    ],
    "q03": [("revenue", 4, "1")], "q05": [("revenue", 4, "1")], "q06": [("revenue", 4, "1")],
    "q07": [("revenue", 4, "1")],
    "q08": [("nation_volume", 4, "1"), ("total_volume", 4, "1")],
    "q09": [("sum_profit", 4, "1")], "q10": [("revenue", 4, "1")],
    "q11": [("value", 2, "1"), ("total_value", 2, "1")],
    "q14": [("promo_value", 4, "1"), ("total_value", 4, "1")],
    "q15": [("total_revenue", 4, "1")], "q17": [("avg_yearly", 2, "7")],
    "q18": [("sum_quantity", 0, "1")], "q19": [("revenue", 4, "1")],
    "q20_shipped": [("sum_quantity", 0, "1")], "q22": [("totacctbal", 2, "1")],
}


def released_query(query: str) -> str:
    """(fn, output, value, digits, divisor) of one release."""
    parts = []
    for name, digits, divisor in _RELEASED[query]:
        keys = [] if (query, name) == ("q11", "total_value") else _KEYS.get(query, [])
        parts.append(
            f"SELECT DISTINCT {fn(f'{query}.{name}', *keys)} AS fn, '{query}.{name}' AS output, "
            f"{name} AS value, {digits} AS digits, {divisor} AS divisor FROM a"
        )
    return f"WITH a AS ({ANSWERS[query]})\n" + "\nUNION ALL ".join(parts)


def evaluation(queries) -> str:
    terms = all_terms(queries)
    rel = "\nUNION ALL ".join(f"SELECT * FROM ({released_query(q)})" for q in queries)
    return f"""WITH terms AS ({terms}), rel AS ({rel}),
        sums AS (SELECT fn, CAST(SUM(CAST(value AS HUGEINT)) AS DOUBLE) AS total, COUNT(*) AS n
                 FROM terms GROUP BY 1),
        checked AS (SELECT output, n,
                abs(coalesce(total, 0) / power(10, digits) / divisor - value) AS err
            FROM rel LEFT JOIN sums USING (fn))
        SELECT output, COUNT(*) AS functions, CAST(SUM(coalesce(n, 0)) AS BIGINT) AS terms,
            round(MAX(err), 4) AS max_abs_err, bool_and(coalesce(err <= 1e-4, true)) AS agrees
        FROM checked GROUP BY 1"""


def operands_cte() -> str:
    return "\nUNION ALL ".join(
        f'SELECT "fn", "row", shape, var_{i} AS v FROM terms WHERE var_{i} IS NOT NULL' for i in (1, 2, 3)
    )


def used(queries) -> str:
    return f"""WITH terms AS ({all_terms(queries)}), ops AS ({operands_cte()})
        SELECT fn, COUNT(DISTINCT v) AS variables FROM ops GROUP BY 1
        UNION ALL SELECT '*', COUNT(DISTINCT v) FROM ops"""


def coverage(queries) -> str:
    return f"""WITH terms AS ({all_terms(queries)}), ops AS ({operands_cte()})
        SELECT v AS var, COUNT(*) AS terms, COUNT(DISTINCT fn) AS functions FROM ops GROUP BY 1"""


def rendered(queries, size: int) -> str:
    def factor(i: int) -> str:
        return f"""CASE WHEN var_{i} IS NULL THEN NULL
            WHEN shift_{i} = 0 THEN var_{i}
            WHEN sign_{i} = 1 THEN '(100+' || var_{i} || ')' ELSE '(100-' || var_{i} || ')' END"""

    return f"""WITH terms AS ({all_terms(queries)}),
        texts AS (SELECT fn, '(' || concat_ws('*',
                CASE WHEN coef <> 1 THEN CAST(CAST(coef AS BIGINT) AS VARCHAR) END,
                {factor(1)}, {factor(2)}, {factor(3)}) || ')' AS text FROM terms),
        counted AS (SELECT fn, CASE WHEN COUNT(*) = 1 THEN text ELSE COUNT(*) || '*' || text END AS text
            FROM texts GROUP BY fn, texts.text),
        spread AS (SELECT fn, text, CAST(ceil(COUNT(*) OVER (PARTITION BY fn) / {size}.0) AS BIGINT) AS pieces,
            CAST('0x' || substring(md5(text), 1, 15) AS BIGINT) AS h FROM counted)
        SELECT fn, h % pieces AS piece, pieces,
            '(' || string_agg(text, '+' ORDER BY text) || ')' AS formula
        FROM spread GROUP BY fn, h % pieces, pieces"""


ALL = list(ROWS)

PROVENANCE = {f"prov_terms_{q}": f"SELECT {_LISTED} FROM ({term_query(q)})" for q in ALL}
PROVENANCE |= {
    "prov_render": rendered(ALL, 1000),
    "prov_eval": evaluation(ALL),
    "prov_vars": used(ALL),
    "prov_coverage": coverage(ALL),
}
