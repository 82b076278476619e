"""Every query and operator as a callable over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumtrace.operators import formulas, interchange, jacobian, provenance, reconstruct, refresh
from sumtrace.operators.components import function_components
from sumtrace.operators.determined import determined, determined_after
from sumtrace.operators.integrity import integrity_report
from sumtrace.operators.packed import occurrence, packed, packed_texts
from sumtrace.operators.report import audit_log, sizes
from sumtrace.operators.rowspace import RowSpace
from sumtrace.operators.terms import RELEASES, release_terms, terms
from sumtrace.plans.catalog import QUERIES, answer
from sumtrace.run import RESULTS, append_timings, run_queries
from sumtrace.session import cut, scratch
from sumtrace.sources import shape
from sumtrace.sources.changes import read_changes, write_changes
from sumtrace.sources.results import read_formulas, write_formulas, write_result
from sumtrace.sources.tables import Tables, write_text

PROFILE = "small"
ALL = list(RELEASES)
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Currency in 10 000, rates as fractions, quantities in tens.
UNITS = {"x8": 1e6, "x9": 100.0, "x7": 10.0}

Build = Callable[[Tables], DataFrame]


def _answers() -> dict[str, Build]:
    return {n: lambda t, n=n: answer(t, n, PROFILE) for n in sorted(QUERIES)}


def _provenance() -> dict[str, Build]:
    listed = {
        f"prov_terms_{n}": lambda t, n=n: provenance.listing(release_terms(t, n, PROFILE))
        for n in ALL
    }
    return listed | {
        "prov_render": lambda t: provenance.render(packed_texts(t, ALL, PROFILE)),
        "prov_eval": lambda t: provenance.evaluation_report(t, ALL, PROFILE),
        "prov_vars": lambda t: provenance.variables_used(packed(t, ALL, PROFILE, occurrence)),
        "prov_coverage": lambda t: provenance.coverage(packed(t, ALL, PROFILE, occurrence)),
    }


def _jac(t: Tables, names: list[str]) -> DataFrame:
    return jacobian.jacobian(packed(t, names, PROFILE))


def _from_files(t: Tables) -> DataFrame:
    """The Jacobian of all releases from nothing but their written formulas and the variable table."""
    terms = cut(formulas.parsed(_released_formulas(t)))
    whole = jacobian.jacobian(formulas.bound(terms, shape.variables(t)))
    return whole


def _incremental(t: Tables) -> DataFrame:
    """All releases first, then the rings of neighbouring lines on top."""
    stored = cut(_jac(t, ALL))
    known = cut(determined(stored))
    return determined_after(known, stored, _cycles(t))


def _rowspace(t: Tables) -> DataFrame:
    """Half of the releases, then the others, then the rings of lines: each step starts from the stored row space."""
    space = RowSpace(t.spark, _scratch(t, "rowspace"))
    for step in (_jac(t, ALL[:8]), _jac(t, ALL[8:]), _cycles(t)):
        space.add(step)
    return space.known().select("var", "step")


def _reconstruct(t: Tables) -> DataFrame:
    """Three rounds of gradient descent on the revenues of q03 and q10, in 10 000."""
    names = ["q03", "q10"]
    scaled = reconstruct.rescaled(terms(t, names, PROFILE), UNITS)
    scaled = scaled.withColumn("coef", F.col("coef") / 1e8)
    targets = provenance.released_values(t, names, PROFILE).select(
        "fn", (F.col("value") / 1e4).alias("target")
    )
    state, _ = reconstruct.descend(scaled, targets, rounds=3)
    return state.select("var", F.round("x", 6).alias("x"))


def _solved(t: Tables) -> DataFrame:
    """The revenues of q03, q05 and q10 with whether values were found that give them, all at once."""
    names = ["q03", "q05", "q10"]
    scaled = reconstruct.rescaled(terms(t, names, PROFILE), UNITS)
    scaled = scaled.withColumn("coef", F.col("coef") / 1e8)
    released = cut(provenance.released_values(t, names, PROFILE).select("fn", "value"))
    found = reconstruct.solve(scaled, released.select("fn", (F.col("value") / 1e4).alias("target")))
    return released.join(found.residuals, "fn", "left").select("fn", "value", (F.abs("f") < 1e-3).alias("solved"))


def _audit() -> dict[str, Build]:
    return {
        "audit_jacobian": lambda t: _jac(t, ALL),
        "audit_from_files": _from_files,
        "audit_singleton": lambda t: jacobian.singletons(packed(t, ALL, PROFILE)),
        "audit_components": lambda t: function_components(packed(t, ALL, PROFILE)),
        "audit_candidates": lambda t: jacobian.candidates(packed(t, ALL, PROFILE)),
        "audit_real": lambda t: determined(_jac(t, ALL)),
        "audit_rings": lambda t: determined(_cycles(t)),
        "audit_incremental": _incremental,
        "audit_rowspace": _rowspace,
        "audit_interchange": lambda t: interchange.exchange_report(terms(t, ALL, PROFILE)),
        "audit_interchange_multi": lambda t: interchange.exchangeable(
            terms(t, ALL, PROFILE)
        ).drop("scope"),
        "audit_join_groups": lambda t: interchange.join_groups(terms(t, ALL, PROFILE)),
        "audit_reconstruct": _reconstruct,
        "audit_solved": _solved,
        "audit_sizes": lambda t: sizes(packed(t, ALL, PROFILE)),
        "audit_log": lambda t: audit_log(t, ALL, PROFILE),
    }


def _cents(name: str, *columns: str) -> Build:
    return lambda t: getattr(t, name).select(*columns)


def _refreshed(t: Tables, change) -> DataFrame:
    orders, lines = t.orders, t.lineitem
    return refresh.orders_with_lines(*change(orders, lines))


def _streams(t: Tables) -> DataFrame:
    """Three refresh streams, written to files, read and applied.

    The second deletes what the first inserts, the third inserts it again for other customers, and
    orders whose keys are taken.
    """
    orders, lines = t.raw("orders"), t.raw("lineitem")
    folder = _scratch(t, "streams")
    keys = [refresh.refresh_keys(orders, n) for n in (1, 2, 3)]
    first, first_lines = refresh.refresh_rows(orders, lines, 1)
    second, second_lines = refresh.refresh_rows(orders, lines, 2)
    taken = orders.join(keys[1], F.col("o_orderkey") == F.col("orderkey"), "left_semi")
    taken_lines = lines.join(keys[1], F.col("l_orderkey") == F.col("orderkey"), "left_semi")
    again = first.unionByName(taken).withColumn("o_custkey", F.col("o_custkey") + 1)
    new_keys = first.select(F.col("o_orderkey").alias("orderkey"))
    write_changes(folder, 1, first, first_lines, keys[0])
    write_changes(folder, 2, second, second_lines, new_keys)
    write_changes(folder, 3, again, first_lines.unionByName(taken_lines), keys[2])
    changes = read_changes(t.spark, folder, t.money_scale)
    return _refreshed(t, lambda o, l: refresh.apply_streams(*_rolled(o, l), changes))


def _rolled(orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns that :func:`refresh.orders_with_lines` shows."""
    shown = ["l_quantity", "l_extendedprice", "l_discount"]
    return orders.select("o_orderkey", "o_custkey"), lines.select(*LINE, *shown)


def _scratch(t: Tables, name: str) -> str:
    """A new folder below the checkpoint folder, for what a query writes and reads again."""
    return f"{scratch(t.spark)}/{name}"


def _released_formulas(t: Tables) -> DataFrame:
    """The formulas of all releases, written as results and read back."""
    written = write_formulas(provenance.released_formulas(t, ALL, PROFILE), _scratch(t, "formulas"))
    return read_formulas(t.spark, written)


def _text_round_trip(t: Tables) -> DataFrame:
    """Lines written as separated text and read back."""
    folder = _scratch(t, "text")
    write_text(t.raw("lineitem"), "lineitem", folder)
    back = Tables(t.spark, folder, fmt="text").raw("lineitem")
    money = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return back.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *money, "l_returnflag", "l_shipdate")


def _views(t: Tables) -> DataFrame:
    """A question asked in SQL over the registered tables."""
    t.register_views()
    return t.spark.sql(
        """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders
        FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY n_name"""
    )


def _written_result(t: Tables) -> DataFrame:
    """An answer written as CSV with a header and read back."""
    path = write_result(answer(t, "q20_shipped", PROFILE), _scratch(t, "results"), "q20")
    schema = "l_partkey BIGINT, l_suppkey BIGINT, sum_quantity DOUBLE"
    return t.spark.read.schema(schema).option("header", True).csv(path)


def _run_all(t: Tables) -> DataFrame:
    """All queries run one after the other, results written, times appended to a log."""
    folder = _scratch(t, "run")
    done = run_queries(t, sorted(RESULTS), f"{folder}/results", PROFILE)
    append_timings(t.spark, done, f"{folder}/times")
    log = t.spark.read.schema("query STRING, status STRING, seconds DOUBLE")
    log = log.option("sep", "\t").option("header", True).csv(f"{folder}/times")
    return log.select("query", "status", (F.col("seconds") > 0).alias("timed"))


def _written_columns(t: Tables) -> DataFrame:
    """Orders written as one dataset per column and read back: values with their counts."""
    folder = _scratch(t, "columns")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    shape.write_columns(t.raw("orders").select(*names), folder)
    parts = [
        t.spark.read.text(f"{folder}/{n}").groupBy("value").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "value", "n")
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def _cycles(t: Tables) -> DataFrame:
    """Each order releases the sums of the prices of every line and the next one, in a ring.

    Rings of an odd number of lines determine every price, by no function alone; even rings none.
    """
    ring = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t.lineitem.select(
        "l_orderkey",
        F.row_number().over(ring).alias("i"),
        F.count("*").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    ).where("n > 1")

    def name(i) -> Column:
        return F.concat_ws("_", "l_orderkey", i.cast("string"))

    own, after = F.col("i"), F.col("i") % F.col("n") + 1
    entries = lines.select(name(own).alias("fn"), F.explode(F.array(name(own), name(after))).alias("var"))
    return entries.groupBy("fn", "var").agg(F.count("*").cast("double").alias("d"))


def _tables() -> dict[str, Build]:
    return {
        "variable_table": shape.variables,
        "variable_codes": shape.variable_codes,
        "cents_lineitem": _cents(
            "lineitem", *LINE, "l_extendedprice", "l_discount", "l_tax"
        ),
        "cents_orders": _cents("orders", "o_orderkey", "o_totalprice"),
        "cents_customer": _cents("customer", "c_custkey", "c_acctbal"),
        "cents_supplier": _cents("supplier", "s_suppkey", "s_acctbal"),
        "cents_part": _cents("part", "p_partkey", "p_retailprice"),
        "cents_partsupp": _cents("partsupp", "ps_partkey", "ps_suppkey", "ps_supplycost"),
        "first_rows": lambda t: shape.first_keys(t, 1000),
        "released_formulas": _released_formulas,
        "text_round_trip": _text_round_trip,
        "sql_views": _views,
        "written_result": _written_result,
        "written_columns": _written_columns,
        "run_all": _run_all,
        "refresh_insert": lambda t: _refreshed(
            t, lambda o, l: refresh.insert_orders(o, l, *refresh.refresh_rows(o, l))
        ),
        "refresh_delete": lambda t: _refreshed(
            t, lambda o, l: refresh.delete_orders(o, l, refresh.refresh_keys(o))
        ),
        "refresh_streams": _streams,
        "order_rollup": lambda t: refresh.order_rollup(t.lineitem, t.unit(2)),
        "line_status": lambda t: refresh.line_status(t.lineitem, date(1998, 6, 17)).select(
            *LINE, "l_returnflag", "l_linestatus"
        ),
        "retail_price": lambda t: t.part.select(
            "p_partkey", (refresh.retail_price(F.col("p_partkey")) / 100.0).alias("price")
        ),
        "part_supplier_bridge": lambda t: refresh.part_supplier_bridge(t.part, t.supplier),
        "sparse_key": lambda t: t.orders.select(
            "o_orderkey", refresh.sparse_key(F.col("o_orderkey"), 1).alias("sparse_key")
        ),
        "country_code": lambda t: refresh.country_codes(t.customer),
        "date_dim": lambda t: refresh.date_dim(t.orders, t.lineitem),
        "ref_integrity": integrity_report,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    builds = _answers() | _provenance() | _audit() | _tables()

    def over_folder(build: Build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: over_folder(build) for name, build in builds.items()}
