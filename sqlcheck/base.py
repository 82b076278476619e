"""Common table expressions: typed base tables with the completed columns."""

from __future__ import annotations

_CTES = {
    "li": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
        l_shipdate,
        CAST(l_quantity AS DECIMAL(12,0)) AS qty,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
        CAST(l_discount AS DECIMAL(4,2)) AS disc,
        CAST(l_tax AS DECIMAL(4,2)) AS tax,
        CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev,
        CAST(round(l_quantity) AS BIGINT) AS q,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS e,
        CAST(round(l_discount * 100) AS BIGINT) AS d,
        CAST(round(l_tax * 100) AS BIGINT) AS t,
        l_shipdate + to_days(CAST((l_orderkey*7 + l_linenumber*13 + l_partkey) % 61 - 30 AS INTEGER)) AS commitdate,
        l_shipdate + to_days(CAST(1 + (l_orderkey + l_linenumber*5 + l_suppkey) % 30 AS INTEGER)) AS receiptdate,
        ['AIR','FOB','MAIL','RAIL','REG AIR','SHIP','TRUCK'][(l_orderkey + l_linenumber) % 7 + 1] AS shipmode,
        ['DELIVER IN PERSON','COLLECT COD','NONE','TAKE BACK RETURN'][(l_partkey + l_suppkey) % 4 + 1] AS instruct,
        concat_ws('_', l_orderkey*7 + l_linenumber - 1, l_partkey, l_suppkey) AS line
        FROM lineitem""",
    "pt": """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
        'Manufacturer#' || (p_partkey % 5 + 1) AS p_mfgr,
        ['SM','LG','MED','JUMBO','WRAP'][p_partkey % 5 + 1] || ' ' ||
        ['CASE','BOX','BAG','JAR','PKG','PACK','CAN','DRUM'][(p_partkey // 5) % 8 + 1] AS p_container
        FROM part""",
    "ps": """SELECT ps_partkey, ps_suppkey, 1 + (ps_partkey*31 + ps_suppkey*17) % 9999 AS availqty,
        CAST((100 + (ps_partkey*7919 + ps_suppkey*104729) % 99901) / 100 AS DECIMAL(12,2)) AS supplycost,
        100 + (ps_partkey*7919 + ps_suppkey*104729) % 99901 AS cost_c,
        concat_ws('_', ps_partkey, ps_suppkey) AS psrow
        FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)""",
    "cu": """SELECT *, (10 + c_nationkey) || '-' || (100 + c_custkey % 900) AS c_phone,
        CAST(c_acctbal AS DECIMAL(12,2)) AS bal, CAST(round(c_acctbal*100) AS BIGINT) AS bal_c
        FROM customer""",
    "su": """SELECT *, CASE WHEN s_suppkey % 20 = 0 THEN 'x Customer y Complaints' ELSE 'ok' END
        AS s_comment FROM supplier""",
    "od": """SELECT *, 0 AS o_shippriority,
        CASE WHEN o_orderkey % 50 = 0 THEN 'special x requests' ELSE 'reg' END AS o_comment
        FROM orders""",
}


def ctes(*names: str, **more: str) -> str:
    """``WITH`` clause of the named base tables and any further expressions, in order."""
    parts = [f"{n} AS ({_CTES[n]})" for n in names]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
