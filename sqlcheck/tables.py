"""Variables, whole units, refresh, derived columns and key checks."""

from __future__ import annotations

from sqlcheck.base import ctes
from sqlcheck.answers import ANSWERS
from sqlcheck.provenance import ALL, released_query, rendered

_VARIABLES = [
    ("part", "x1", "p_partkey", "p_retailprice * 100"),
    ("supplier", "x2", "s_suppkey", "s_acctbal * 100"),
    ("ps", "x3", "psrow", "availqty"),
    ("ps", "x4", "psrow", "cost_c"),
    ("customer", "x5", "c_custkey", "c_acctbal * 100"),
    ("orders", "x6", "o_orderkey", "o_totalprice * 100"),
    ("li", "x7", "line", "q"),
    ("li", "x8", "line", "e"),
    ("li", "x9", "line", "d"),
    ("li", "x10", "line", "t"),
]

_ORDER_LINES = """
    SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity) AS BIGINT) AS l_quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS l_discount
    FROM o LEFT JOIN l ON o_orderkey = l_orderkey"""

# a thousandth of the orders, those with the least keys
_CHOSEN = """chosen AS (SELECT o_orderkey AS k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r
        FROM orders) WHERE r <= (SELECT ceil(COUNT(*) / 1000.0) FROM orders))"""
_MAX = "(SELECT MAX(o_orderkey) + 1 FROM orders)"



def _in_turn() -> str:
    """Three streams applied one after the other: insert unless the key is taken, then delete."""
    size = "(SELECT CAST(ceil(COUNT(*) / 1000.0) AS BIGINT) FROM orders)"
    parts = ["ranked AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)"]
    parts += [f"c{n} AS (SELECT k FROM ranked WHERE r > {n - 1} * {size} AND r <= {n} * {size})" for n in (1, 2, 3)]
    # per stream: (range, shift of keys, shift of customers) to insert, and the keys to delete
    inserts = {1: [(1, _MAX, 0)], 2: [(2, _MAX, 0)], 3: [(1, _MAX, 1), (2, "0", 1)]}
    deletes = {1: "SELECT k FROM c1", 2: f"SELECT k + {_MAX} FROM c1", 3: "SELECT k FROM c3"}
    parts += ["o0 AS (SELECT o_orderkey, o_custkey FROM orders)", "l0 AS (SELECT * FROM lineitem)"]
    for n in (1, 2, 3):
        for c, shift, more in inserts[n]:
            own = f"u{n}{c}"
            parts += [
                f"{own} AS (SELECT o_orderkey + {shift} AS o_orderkey, o_custkey + {more} AS o_custkey FROM orders"
                f" WHERE o_orderkey IN (SELECT k FROM c{c}) AND o_orderkey + {shift} NOT IN (SELECT o_orderkey FROM o{n - 1}))",
                f"v{n}{c} AS (SELECT * REPLACE (l_orderkey + {shift} AS l_orderkey) FROM lineitem"
                f" WHERE l_orderkey IN (SELECT k FROM c{c}) AND l_orderkey + {shift} IN (SELECT o_orderkey FROM {own}))",
            ]
        new = [c for c, _, _ in inserts[n]]
        parts += [
            f"{t}{n} AS (SELECT * FROM ({' UNION ALL '.join([f'SELECT * FROM {t}{n - 1}', *(f'SELECT * FROM {u}{n}{c}' for c in new)])})"
            f" WHERE {key} NOT IN ({deletes[n]}))"
            for t, u, key in (("o", "u", "o_orderkey"), ("l", "v", "l_orderkey"))
        ]
    return ", ".join([*parts, "o AS (SELECT * FROM o3)", "l AS (SELECT * FROM l3)"])


_STREAMS = _in_turn()

_KEYS = {
    "region": ("region", "r_regionkey"),
    "nation": ("nation", "n_nationkey"),
    "part": ("part", "p_partkey"),
    "supplier": ("supplier", "s_suppkey"),
    "partsupp": ("ps", "ps_partkey, ps_suppkey"),
    "customer": ("customer", "c_custkey"),
    "orders": ("orders", "o_orderkey"),
    "lineitem": ("lineitem", "l_orderkey, l_linenumber"),
}


def _cents(table: str, keys: str, *money: str) -> str:
    cols = ", ".join(f"CAST(round({c} * 100) AS BIGINT) AS {c}" for c in money)
    return f"SELECT {keys}, {cols} FROM {table}"


def _pk(table: str, keys: str, source: str | None = None) -> str:
    return f"""SELECT 'primary key' AS kind, '{table}' AS name, COUNT(*) AS violations
        FROM (SELECT 1 FROM {source or table} GROUP BY {keys} HAVING COUNT(*) > 1)"""


def _fk(child: str, parent: str, on: str, source: str | None = None, target: str | None = None) -> str:
    return f"""SELECT 'foreign key' AS kind, '{child} -> {parent}' AS name, COUNT(*) AS violations
        FROM {source or child} WHERE NOT EXISTS (SELECT 1 FROM {target or parent} WHERE {on})"""


TABLES = {
    "variable_table": ctes("li", "ps") + " UNION ALL ".join(
        f"SELECT '{tag}_' || {row} AS var, CAST(round({x}) AS DOUBLE) AS x FROM {table}"
        for table, tag, row, x in _VARIABLES
    ),
    "variable_codes": ctes(
        "li", "ps",
        v=" UNION ALL ".join(f"SELECT '{tag}_' || {row} AS var FROM {table}" for table, tag, row, _ in _VARIABLES),
        p="""SELECT var, [CAST(x AS HUGEINT) FOR x IN string_split(substr(var, 2), '_')] AS d FROM v""",
        q="SELECT var, d[1] AS a, coalesce(d[2], 0) AS b, coalesce(d[3], 0) AS c, coalesce(d[4], 0) AS e FROM p",
    ) + """SELECT var, CAST(((a * (SELECT max(b) + 1 FROM q) + b) * (SELECT max(c) + 1 FROM q) + c)
            * (SELECT max(e) + 1 FROM q) + e AS VARCHAR) AS code FROM q""",
    "cents_lineitem": _cents(
        "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey",
        "l_extendedprice", "l_discount", "l_tax",
    ),
    "cents_orders": _cents("orders", "o_orderkey", "o_totalprice"),
    "cents_customer": _cents("customer", "c_custkey", "c_acctbal"),
    "cents_supplier": _cents("supplier", "s_suppkey", "s_acctbal"),
    "cents_part": _cents("part", "p_partkey", "p_retailprice"),
    "cents_partsupp": ctes("ps") + "SELECT ps_partkey, ps_suppkey, cost_c AS ps_supplycost FROM ps",
    "first_rows": ctes("ps") + " UNION ALL ".join(
        f"SELECT '{name}' AS name, concat_ws('|', {keys}) AS key FROM (SELECT {keys} FROM {table} ORDER BY {keys} LIMIT 1000)"
        for name, (table, keys) in _KEYS.items()
    ),
    "released_formulas": f"""WITH texts AS ({rendered(ALL, 1000)}),
        rel AS ({" UNION ALL ".join(f"SELECT * FROM ({released_query(q)})" for q in ALL)})
        SELECT fn, piece, pieces, formula, value FROM texts JOIN rel USING (fn)""",
    "text_round_trip": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""",
    "sql_views": """SELECT n_name, COUNT(DISTINCT c_custkey) AS customers, COUNT(o_orderkey) AS orders
        FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "written_result": ANSWERS["q20_shipped"],
    "written_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM orders GROUP BY {c}"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ),
    "run_all": " UNION ALL ".join(f"SELECT 'q{n:02d}' AS query, 'ok' AS status, true AS timed" for n in range(1, 23)),
    "refresh_insert": f"""WITH {_CHOSEN}, o AS (SELECT o_orderkey, o_custkey FROM orders UNION ALL
            SELECT o_orderkey + {_MAX}, o_custkey FROM orders JOIN chosen ON o_orderkey = k),
        l AS (SELECT * FROM lineitem UNION ALL
            SELECT * REPLACE (l_orderkey + {_MAX} AS l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT k FROM chosen))"""
    + _ORDER_LINES,
    "refresh_delete": f"""WITH {_CHOSEN}, o AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT k FROM chosen)),
        l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM chosen))"""
    + _ORDER_LINES,
    "refresh_streams": f"WITH {_STREAMS}" + _ORDER_LINES,
    "order_rollup": ctes("li") + """
        SELECT l_orderkey, CAST(SUM((e * (100 - d) // 100) * (100 + t) // 100) AS DOUBLE) / 100 AS o_totalprice,
            CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_or(l_linestatus = 'F') THEN 'P'
                 ELSE 'O' END AS o_orderstatus
        FROM li GROUP BY 1""",
    "line_status": ctes("li") + """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CASE WHEN receiptdate > DATE '1998-06-17' THEN 'N' ELSE l_returnflag END AS l_returnflag,
            CASE WHEN l_shipdate <= DATE '1998-06-17' THEN 'F' ELSE 'O' END AS l_linestatus
        FROM li""",
    "retail_price": """SELECT p_partkey,
        (90000 + (p_partkey // 10) % 20001 + (p_partkey % 1000) * 100) / 100.0::DOUBLE AS price FROM part""",
    "part_supplier_bridge": """SELECT p_partkey AS partkey,
            CAST((p_partkey + s * (n // 4 + CAST(trunc((p_partkey - 1) / n) AS BIGINT))) % n + 1 AS BIGINT) AS suppkey
        FROM part, (SELECT COUNT(*) AS n FROM supplier), range(4) AS r(s)""",
    "sparse_key": """SELECT o_orderkey,
        ((((o_orderkey // 8) * 4) + 1) * 8) + o_orderkey % 8 AS sparse_key FROM orders""",
    "country_code": "SELECT c_custkey, CAST(10 + c_nationkey AS VARCHAR) AS country_code FROM customer",
    "date_dim": """SELECT date_diff('day', DATE '1970-01-01', d) AS timekey, d AS day,
            CAST(year(d) AS INTEGER) AS year,
            CAST(date_diff('month', DATE '1970-01-01', d) + 1 AS INTEGER) AS month,
            CAST((dayofyear(d) + 2) // 7 + 1 AS INTEGER) AS week,
            CAST(day(d) AS INTEGER) AS day_of_month
        FROM (SELECT CAST(unnest(range(
            (SELECT MIN(o_orderdate) FROM orders),
            (SELECT MAX(l_shipdate) FROM lineitem) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d)""",
    "ref_integrity": ctes("ps") + " UNION ALL ".join(
        [
            _pk("region", "r_regionkey"),
            _pk("nation", "n_nationkey"),
            _pk("part", "p_partkey"),
            _pk("supplier", "s_suppkey"),
            _pk("partsupp", "ps_partkey, ps_suppkey", "ps"),
            _pk("customer", "c_custkey"),
            _pk("orders", "o_orderkey"),
            _pk("lineitem", "l_orderkey, l_linenumber"),
            _fk("nation", "region", "r_regionkey = n_regionkey"),
            _fk("supplier", "nation", "n_nationkey = s_nationkey"),
            _fk("customer", "nation", "n_nationkey = c_nationkey"),
            _fk("partsupp", "supplier", "s_suppkey = ps_suppkey", "ps"),
            _fk("partsupp", "part", "p_partkey = ps_partkey", "ps"),
            _fk("orders", "customer", "c_custkey = o_custkey"),
            _fk("lineitem", "orders", "o_orderkey = l_orderkey"),
            _fk("lineitem", "partsupp", "ps_partkey = l_partkey AND ps_suppkey = l_suppkey", None, "ps"),
        ]
    ),
}
