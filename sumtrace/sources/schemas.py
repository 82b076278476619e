"""Declared schemas of the ``|``-separated text tables; ``*_var`` names the value before it."""

from __future__ import annotations

SCHEMAS = {
    "customer": """c_custkey BIGINT, c_name STRING, c_address STRING, c_nationkey BIGINT,
        c_phone STRING, c_acctbal DOUBLE, c_acctbal_var STRING, c_mktsegment STRING,
        c_comment STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber BIGINT,
        l_quantity DOUBLE, l_quantity_var STRING, l_extendedprice DOUBLE,
        l_extendedprice_var STRING, l_discount DOUBLE, l_discount_var STRING, l_tax DOUBLE,
        l_tax_var STRING, l_returnflag STRING, l_linestatus STRING, l_shipdate DATE,
        l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING, l_shipmode STRING,
        l_comment STRING""",
    "nation": "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT, n_comment STRING",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_totalprice_var STRING, o_orderdate DATE, o_orderpriority STRING, o_clerk STRING,
        o_shippriority BIGINT, o_comment STRING""",
    "part": """p_partkey BIGINT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING,
        p_size BIGINT, p_container STRING, p_retailprice DOUBLE, p_retailprice_var STRING,
        p_comment STRING""",
    "partsupp": """ps_partkey BIGINT, ps_suppkey BIGINT, ps_availqty BIGINT,
        ps_availqty_var STRING, ps_supplycost DOUBLE, ps_supplycost_var STRING,
        ps_comment STRING""",
    "region": "r_regionkey BIGINT, r_name STRING, r_comment STRING",
    "supplier": """s_suppkey BIGINT, s_name STRING, s_address STRING, s_nationkey BIGINT,
        s_phone STRING, s_acctbal DOUBLE, s_acctbal_var STRING, s_comment STRING""",
}

PRIMARY_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "partsupp": ["ps_partkey", "ps_suppkey"],
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}

# (table, columns, referenced table)
FOREIGN_KEYS = [
    ("nation", ["n_regionkey"], "region"),
    ("supplier", ["s_nationkey"], "nation"),
    ("customer", ["c_nationkey"], "nation"),
    ("partsupp", ["ps_suppkey"], "supplier"),
    ("partsupp", ["ps_partkey"], "part"),
    ("orders", ["o_custkey"], "customer"),
    ("lineitem", ["l_orderkey"], "orders"),
    ("lineitem", ["l_partkey", "l_suppkey"], "partsupp"),
]
