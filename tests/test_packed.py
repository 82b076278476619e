"""Packed terms give what the terms one by one give, also for rows with nulls and rows that come twice."""

import datetime
import random

import pytest

from sumtrace import registry
from sumtrace.operators import jacobian, provenance
from sumtrace.operators.components import function_components
from sumtrace.operators.packed import occurrence, packed, packed_texts
from sumtrace.operators.report import sizes
from sumtrace.operators.terms import terms
from sumtrace.sources.tables import Tables

ALL = registry.ALL


def write_tables(spark, folder, lines=400):
    rng = random.Random(7)
    day = lambda y, m: datetime.datetime(y, m, 1 + rng.randrange(28))
    odd = lambda v: None if rng.random() < 0.04 else v
    line = [
        (odd(rng.randrange(30)), odd(rng.randrange(12)), odd(rng.randrange(6)), odd(rng.randrange(1, 5)), odd(float(rng.randrange(1, 50))),
         odd(rng.choice([0.0, 905.5, 12000.25])), odd(rng.randrange(11) / 100), odd(rng.randrange(9) / 100), odd(rng.choice("AR")), odd(rng.choice("FO")),
         day(1996 + rng.randrange(3), 1 + rng.randrange(12)))
        for _ in range(lines)
    ]
    tables = {
        "lineitem": (line + line[:60], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(i, odd(i % 8), "O", 100.0 + i, day(1996, 1 + i % 12), "1-URGENT") for i in range(30)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(i, f"c{i}", 6 + i % 2, odd(10.0 * i - 5), "BUILDING") for i in range(12)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", 6 + i % 2, 5.0 * i) for i in range(6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(i, "blue bolt", "Brand#23", rng.choice(["ECONOMY", "PROMO"]), 5, 900.0) for i in range(12)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "nation": ([(i, f"NATION_{i}", 1 + i % 2) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "AMERICA"), (2, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    write_tables(spark, folder)
    return Tables(spark, folder)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def one_by_one(odd):
    return terms(odd, ALL, "small").localCheckpoint()


@pytest.mark.parametrize("per_query", [False, True])
def test_jacobian(odd, one_by_one, per_query):
    want = rows(jacobian.jacobian(one_by_one, per_query))
    assert len(want) > 1000
    assert rows(jacobian.jacobian(packed(odd, ALL, "small"), per_query)) == want


@pytest.mark.parametrize("operator", [jacobian.singletons, jacobian.candidates, function_components])
def test_operators(odd, one_by_one, operator):
    found = rows(operator(packed(odd, ALL, "small")))
    if operator is jacobian.candidates:
        want = jacobian.column_signatures(jacobian.jacobian(one_by_one)).groupBy("n", "h1", "h2").agg({"var": "min", "*": "count"})
        assert found == sorted((r["min(var)"],) for r in want.collect() if r["count(1)"] == 1)
    else:
        assert found == rows(operator(jacobian.jacobian(one_by_one)))


def test_sizes(odd, one_by_one):
    assert rows(sizes(packed(odd, ALL, "small"))) == rows(sizes(jacobian.jacobian(one_by_one, per_query=True)))


@pytest.mark.parametrize("operator", [provenance.coverage, provenance.variables_used])
def test_occurrences(odd, one_by_one, operator):
    assert rows(operator(packed(odd, ALL, "small", occurrence))) == rows(operator(one_by_one))


@pytest.mark.parametrize("name", ["audit_jacobian", "audit_singleton", "audit_candidates", "audit_sizes", "prov_vars", "prov_coverage"])
def test_entries_are_not_dealt_by_name(spark, odd, name):
    """A line has ten entries and more; dealt one by one, with names, they were written once or several times."""
    plan = registry.queries()[name](spark, odd.folder)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "var#" in x.split("hashpartitioning(")[1].split(")")[0]]


def test_components_write_sets_only(spark, odd, monkeypatch):
    """The Jacobian itself is not written."""
    from sumtrace.operators import components

    written = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(df.columns) or real(df))
    monkeypatch.setattr(registry, "cut", lambda df: written.append(df.columns) or real(df))
    registry.queries()["audit_components"](spark, odd.folder).count()
    assert written and not [c for c in written if "var" in c]


@pytest.mark.parametrize("size", [1000, 7])
def test_render(odd, one_by_one, size):
    found = rows(provenance.render(packed_texts(odd, ALL, "small"), size))
    assert found == rows(provenance.render(one_by_one, size))
    assert any("2*(" in r[1] for r in found)


def test_render_writes_packed_rows(spark, odd, monkeypatch):
    """A line is written once, not once for each of its terms, and texts are dealt once."""
    written = []
    for module in (provenance, registry):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, real=real: written.append(df.columns) or real(df))
    plan = registry.queries()["prov_render"](spark, odd.folder)._jdf.queryExecution().executedPlan().toString()
    assert written and not [c for c in written if "var_1" in c]
    assert len([x for x in plan.splitlines() if "hashpartitioning(" in x]) == 1


def test_formula_files_are_compressed(spark, odd, tmp_path):
    from sumtrace.sources.results import read_formulas, write_formulas

    written = [("f", 0, 1, '(x8_1_2_3*(100-x9_1_2_3)+"a, b")', 1.5), ("g", 0, 1, "(x7_1_2_3)", None)]
    df = spark.createDataFrame(written, "fn string, piece long, pieces long, formula string, value double")
    folder = write_formulas(df, str(tmp_path / "formulas"))
    assert all(f.name.endswith(".csv.gz") for f in tmp_path.glob("formulas/part-*"))
    assert rows(read_formulas(spark, folder)) == rows(df)
