import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sumtrace.operators import refresh
from sumtrace.sources.changes import Changes, read_changes


def test_orders_with_a_taken_key_stay_out_with_their_lines(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "o_orderkey long, o_note string")
    lines = spark.createDataFrame([(1, 1), (2, 1)], "l_orderkey long, l_linenumber int")
    new_orders = spark.createDataFrame([(2, "again"), (3, "c")], orders.schema)
    new_lines = spark.createDataFrame([(2, 9), (3, 1), (3, 2), (4, 1)], lines.schema)
    o, l = refresh.insert_orders(orders, lines, new_orders, new_lines)
    assert sorted(map(tuple, o.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, l.collect())) == [(1, 1), (2, 1), (3, 1), (3, 2)]
    gone = spark.createDataFrame([(1,), (1,), (3,)], "orderkey long")
    o, l = refresh.delete_orders(o, l, gone)
    assert [r.o_orderkey for r in o.collect()] == [2]
    assert [r.l_orderkey for r in l.collect()] == [2]


def test_insert_then_delete_gives_the_base_back(tables):
    orders, lines = tables.orders, tables.lineitem
    new_orders, new_lines = refresh.refresh_rows(orders, lines, stream=2)
    assert new_orders.count() == 2
    more = refresh.insert_orders(orders, lines, new_orders, new_lines)
    keys = new_orders.select(F.col("o_orderkey").alias("orderkey"))
    back = refresh.delete_orders(*more, keys)
    assert back[0].exceptAll(orders).isEmpty() and orders.exceptAll(back[0]).isEmpty()
    assert back[1].count() == lines.count()


def test_sparse_keys_and_prices(spark):
    df = spark.createDataFrame([(7,), (8,), (12345,)], "i long").select(
        refresh.sparse_key(F.col("i"), 0).alias("base"),
        refresh.sparse_key(F.col("i"), 1).alias("later"),
        refresh.retail_price(F.col("i")).alias("cents"),
    )
    want = [
        ((i >> 3 << 2) << 3 | i & 7, ((i >> 3 << 2) + 1) << 3 | i & 7, 90000 + i // 10 % 20001 + i % 1000 * 100)
        for i in (7, 8, 12345)
    ]
    assert list(map(tuple, df.collect())) == want


def test_status_follows_the_day(spark):
    day = date(1995, 6, 17)
    rows = [(1, date(1995, 6, 16), date(1995, 6, 18), "A"), (1, date(1995, 6, 18), date(1995, 6, 20), "R")]
    rows += [(2, date(1995, 6, 17), date(1995, 6, 17), "R")]
    lines = spark.createDataFrame(
        rows, "l_orderkey long, l_shipdate date, l_receiptdate date, l_returnflag string"
    ).withColumns({"l_extendedprice": F.lit(10001), "l_discount": F.lit(7), "l_tax": F.lit(3)})
    stated = refresh.line_status(lines, day)
    got = [(r.l_returnflag, r.l_linestatus) for r in stated.orderBy("l_shipdate").collect()]
    assert got == [("N", "F"), ("R", "F"), ("N", "O")]
    rolled = {r.l_orderkey: (r.o_totalprice, r.o_orderstatus) for r in refresh.order_rollup(stated).collect()}
    cents = 10001 * 93 // 100 * 103 // 100
    assert rolled == {1: (2 * cents / 100, "P"), 2: (cents / 100, "F")}


def test_refresh_goes_by_rank_whatever_the_keys(spark):
    keys = sorted({(i * i * 7919) % 10_000_019 * 8 + i % 3 for i in range(2500)})
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    for stream in (1, 2, 5):
        got = sorted(r[0] for r in refresh.refresh_keys(orders, stream).collect())
        assert got == keys[3 * (stream - 1) : 3 * stream]
    assert [refresh.key_at(orders, r) for r in (0, 1234, len(keys) - 1, len(keys))] == [keys[0], keys[1234], keys[-1], None]
    assert refresh.refresh_keys(orders, 900).isEmpty()
    assert refresh.refresh_keys(orders.limit(0)).isEmpty()


def in_turn(orders, lines, streams):
    """Streams of (orders, lines, keys) one after the other on plain lists."""
    for new_orders, new_lines, keys in streams:
        there = {k for k, _ in orders}
        fresh = [o for o in new_orders if o[0] not in there]
        orders = orders + fresh
        lines = lines + [x for x in new_lines if x[0] in {k for k, _ in fresh}]
        orders = [o for o in orders if o[0] not in keys]
        lines = [x for x in lines if x[0] not in keys]
    return sorted(orders), sorted(lines)


def test_streams_equal_their_changes_in_turn(spark):
    r = random.Random(5)
    for _ in range(3):
        orders = [(k, f"base{k}") for k in range(12)]
        lines = [(r.randrange(14), n) for n in range(30)]
        streams = []
        for s in range(1, 5):
            own = [(r.randrange(20), f"s{s}.{i}") for i in range(6)]
            streams.append((own, [(r.randrange(20), 100 * s + n) for n in range(20)], {r.randrange(20) for _ in range(4)}))
        new = [(k, x, s) for s, (own, _, _) in enumerate(streams, 1) for k, x in own]
        new_lines = [(k, x, s) for s, (_, own, _) in enumerate(streams, 1) for k, x in own]
        gone = [(k, s) for s, (_, _, own) in enumerate(streams, 1) for k in own]
        changes = Changes(
            spark.createDataFrame(new, "o_orderkey long, o_note string, stream int"),
            spark.createDataFrame(new_lines, "l_orderkey long, l_linenumber int, stream int"),
            spark.createDataFrame(gone, "orderkey long, stream int"),
        )
        o, l = refresh.apply_streams(
            spark.createDataFrame(orders, "o_orderkey long, o_note string"), spark.createDataFrame(lines, "l_orderkey long, l_linenumber int"), changes
        )
        assert (sorted(map(tuple, o.collect())), sorted(map(tuple, l.collect()))) == in_turn(orders, lines, streams)


def test_streams_from_files_in_pieces(spark, tmp_path):
    order = "{}|7|O|12.50||1995-01-02|1-URGENT|c|0|note|\n".format
    (tmp_path / "orders.tbl").write_text(order(1))
    (tmp_path / "orders.tbl.u1").write_text(order(5))
    (tmp_path / "orders.tbl.u12.3").write_text(order(6) + order(5))
    (tmp_path / "delete.1").write_text("5\n\n1|\n")
    (tmp_path / "delete.u2.1").write_text("6\n")
    found = read_changes(spark, str(tmp_path))
    assert sorted((r.o_orderkey, r.stream, r.o_totalprice) for r in found.orders.collect()) == [(5, 1, 1250), (5, 12, 1250), (6, 12, 1250)]
    assert sorted(map(tuple, found.deletes.collect())) == [(1, 1), (5, 1), (6, 2)]
    assert found.lines.isEmpty() and "l_orderkey" in found.lines.columns
    (tmp_path / "delete.3").write_text("five\n")
    with pytest.raises(Exception, match="not an order key"):
        read_changes(spark, str(tmp_path)).deletes.collect()


def test_no_streams_change_nothing(spark, tables, tmp_path):
    orders, lines = tables.orders.select("o_orderkey", "o_custkey"), tables.lineitem.select("l_orderkey", "l_linenumber")
    o, l = refresh.apply_streams(orders, lines, read_changes(spark, str(tmp_path)))
    assert o.exceptAll(orders).isEmpty() and o.count() == orders.count() and l.count() == lines.count()
