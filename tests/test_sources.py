import glob
import os

import pytest
from pyspark.sql import functions as F

from sumtrace.operators.provenance import released_formulas
from sumtrace.plans.catalog import answer
from sumtrace.run import append_timings, run_queries
from sumtrace.sources import shape
from sumtrace.sources.results import read_formulas, read_released, write_formulas, write_result
from sumtrace.sources.schemas import SCHEMAS
from sumtrace.sources.tables import Tables, read_text


def write_text(tables, folder, times_100=False):
    """All tables as text, in the declared column order, with a separator at the line's end."""
    for name, ddl in SCHEMAS.items():
        df = getattr(tables, name).toPandas()
        money = {"p_retailprice", "s_acctbal", "ps_supplycost", "c_acctbal", "o_totalprice"}
        money |= {"l_extendedprice", "l_discount", "l_tax"}
        lines = []
        for row in df.to_dict("records"):
            cells = []
            for column in [c.split()[0] for c in ddl.split(",")]:
                v = row.get(column, "text" if not column.endswith("_var") else "(x0_0)")
                if column in money:
                    v = int(v) if times_100 else f"{int(v) / 100:.2f}"
                elif column.endswith("date"):
                    v = str(v)[:10]
                cells.append(str(v))
            lines.append("|".join(cells) + "|\n")
        half = len(lines) // 2
        with open(f"{folder}/{name}.tbl", "w") as f:
            f.writelines(lines[:half] if name == "lineitem" else lines)
        if name == "lineitem":
            with open(f"{folder}/{name}.tbl.2", "w") as f:
                f.writelines(lines[half:])


@pytest.fixture(scope="module")
def text_folder(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("text"))
    write_text(tables, folder)
    return folder


@pytest.mark.parametrize("name", ["q01", "q03", "q09", "q16", "q18", "q22"])
def test_text_tables_give_the_same_answers(spark, tables, text_folder, name):
    text = answer(Tables(spark, text_folder, "text"), name, "small")
    stored = answer(tables, name, "small")
    common = [c for c in stored.columns if c in text.columns]
    assert text.select(common).collect() == stored.select(common).collect()


def test_multiplied_input_keeps_whole_units(spark, tables, tmp_path):
    write_text(tables, str(tmp_path), times_100=True)
    whole = Tables(spark, str(tmp_path), "text", money_scale=100)
    got = answer(whole, "q06", "small").first().revenue
    assert got == round(answer(tables, "q06", "small").first().revenue * 10**4)


def test_refresh_files_are_not_read_and_bad_lines_fail(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA|one|\n1|ASIA|two|\n")
    (tmp_path / "region.tbl.1").write_text("2|EUROPE|three|\n")
    (tmp_path / "region.tbl.u1").write_text("9|NOWHERE|four|\n")
    assert read_text(spark, str(tmp_path), "region").count() == 3
    (tmp_path / "region.tbl.3").write_text("x|BROKEN|five|\n")
    with pytest.raises(Exception):
        read_text(spark, str(tmp_path), "region").collect()


def test_views(spark, tables):
    tables.register_views()
    assert spark.sql("SELECT COUNT(*) FROM orders").first()[0] == tables.orders.count()


def test_runner_writes_results_and_logs_failures(spark, tables, tmp_path, monkeypatch):
    import sumtrace.run as run

    monkeypatch.setitem(run.RESULTS, "q02", ["no_such_query"])
    done = run_queries(tables, ["q02", "q06", "q20"], str(tmp_path), "small")
    assert [(q, s) for q, s, _ in done] == [("q02", "failed"), ("q06", "ok"), ("q20", "ok")]
    assert sorted(os.listdir(tmp_path)) == ["Q06-0", "Q20-0", "Q20-1"]
    times = str(tmp_path / "times")
    append_timings(spark, done, times)
    append_timings(spark, done, times)
    stored = spark.read.option("header", True).option("sep", "\t").csv(times)
    assert stored.columns == ["query", "status", "seconds"] and stored.count() == 6


def test_formulas_of_any_length_survive_csv(spark, tables, tmp_path):
    df = released_formulas(tables, ["q18", "q06"], "small", size=20)
    back = read_formulas(spark, write_formulas(df, str(tmp_path / "formulas")))
    rows = sorted(map(tuple, back.collect()))
    assert rows == sorted(map(tuple, df.collect()))
    pieces = [r for r in rows if r[0].startswith("q06")]
    assert len(pieces) > 1 and {r[2] for r in pieces} == {len(pieces)} and all(r[3] for r in rows)


def test_released_pairs_of_a_written_result(spark, tmp_path):
    rows = [("a", 1.5, "(x8_1+x8_2)", 7), ("b", 2.5, "(x8_3)", 8)]
    path = write_result(spark.createDataFrame(rows, "k string, v double, v_formula string, n int"), str(tmp_path), "q18")
    assert path.endswith("Q18-0") and glob.glob(f"{path}/part-*.csv")
    assert {r.formula: r.value for r in read_released(spark, path).collect()} == {"(x8_1+x8_2)": 1.5, "(x8_3)": 2.5}
    assert read_released(spark, path, limit=1).count() == 1


def test_columns_and_first_rows(spark, tables, tmp_path):
    shape.write_columns(tables.nation, str(tmp_path / "columns"))
    names = spark.read.text(str(tmp_path / "columns" / "n_name"))
    assert names.count() == 25
    shape.write_first_rows(tables, str(tmp_path / "small"), 10)
    small = Tables(spark, str(tmp_path / "small"), money_scale=100)
    assert small.lineitem.count() == 10 and small.partsupp.count() == 10
    assert small.orders.agg(F.max("o_orderkey")).first()[0] == 9


def test_codes_of_large_keys_differ(spark, monkeypatch):
    names = ["x1_1000000", "x2_0", "x1_0", "x7_5_1_2", "x7_51_2_0", "x7_5_12_0", "x10_0_0_0", "x9_99999999999_5_3"]
    monkeypatch.setattr(shape, "variables", lambda t: spark.createDataFrame([(n, 0.0) for n in names], "var string, x double"))
    rows = shape.variable_codes(None).collect()
    assert len({r.code for r in rows}) == len(names) and all(r.code.isdigit() for r in rows)
