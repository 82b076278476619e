"""Plans and results that have to hold at any size."""

import os
import re
import shutil

import pytest

import __spark_entry__ as contract
from check import compare
from sumtrace.plans.catalog import answer
from sumtrace.sources.tables import Tables
from tests.conftest import SMALL, attach

QUERIES = contract.queries()
SQL = contract.oracle_sql()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(tables):
    text = answer(tables, "q06", "small")._jdf.queryExecution().explainString(
        tables.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_orderkey" not in text and "l_tax" not in text


@pytest.mark.parametrize("name, columns", [("q06", ["l_discount", "l_quantity"]), ("q19", ["l_quantity"]), ("q22", ["c_acctbal"])])
def test_bounds_on_scaled_columns_reach_the_scan(tables, name, columns):
    tables.spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        text = plan(answer(tables, name, "small"))
    finally:
        tables.spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = "".join(re.findall(r"PushedFilters: \[[^\]]*\]", text))
    for column in columns:
        assert f"ThanOrEqual({column}," in pushed


@pytest.mark.parametrize("name", [f"q{n:02d}" for n in range(1, 23)])
def test_no_python_cross_join_or_window(tables, name):
    text = plan(answer(tables, name, "small"))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
    # q17's window runs over rows that are already summed per part and quantity
    assert ("Window" in text) == (name == "q17")


def lineitem_shuffles(t, name):
    """Shuffles between a scan of the lines and the answer, when nothing is broadcast."""
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(answer(t, name, "small")).split("\n")
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "l_orderkey" in line]
    counts = []
    for i in scans:
        depth, count = len(lines[i]) - len(lines[i].lstrip(" :+-*(")), 0
        for line in reversed(lines[:i]):
            d = re.search(r"[A-Za-z]", line).start()
            if d < depth:
                depth = d
                count += "Exchange hashpartitioning" in line
        counts.append(count)
    return counts


@pytest.mark.parametrize("name, most", [("q03", 1), ("q18", 2), ("q21", 3), ("q12", 2), ("q10", 3), ("q05", 3), ("q07", 3)])
def test_lines_are_shuffled_no_more_than_needed(tables, name, most):
    counts = lineitem_shuffles(tables, name)
    assert counts and max(counts) <= most


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_number_of_partitions_does_not_matter(spark, db, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("q03", "q09", "q13", "q15", "q21", "audit_candidates"):
            result, _ = compare(spark, db, SMALL, name, QUERIES[name], SQL[name])
            assert result.startswith("ok"), (name, result)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The smallest tables with a third of all lines on one order, part and supplier."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    made = str(tmp_path_factory.mktemp("lines"))
    db = attach(SMALL)
    for file in os.listdir(SMALL):
        if file != "lineitem.parquet":
            shutil.copy(f"{SMALL}/{file}", folder)
    db.execute(
        f"""COPY (SELECT * EXCLUDE (hot) REPLACE (
            CASE WHEN hot THEN 7 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN hot THEN 2 ELSE l_partkey END AS l_partkey,
            CASE WHEN hot THEN 3 ELSE l_suppkey END AS l_suppkey)
        FROM (SELECT *, row_number() OVER () % 3 = 0 AS hot FROM lineitem))
        TO '{made}/lineitem.parquet' (FORMAT parquet)"""
    )
    lines = spark.read.parquet(f"{made}/lineitem.parquet")
    lines.repartition(6).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize(
    "name",
    ["q03", "q05", "q07", "q08", "q09", "q10", "q12", "q14", "q17", "q19", "q18", "q20", "q21", "prov_terms_q09", "order_rollup"],
)
def test_hot_keys(spark, skewed, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result, _ = compare(spark, attach(skewed), skewed, name, QUERIES[name], SQL[name])
        assert result.startswith("ok"), result
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark, tables, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        tables.raw(name).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = Tables(spark, str(tmp_path))
    for name in ("q01", "q08", "q11", "q15", "q22"):
        assert answer(empty, name, "small").count() == 0
    assert answer(empty, "q06", "small").first().revenue is None
    assert answer(empty, "q14", "small").first().promo_revenue is None


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
}


@pytest.mark.parametrize("name", ["q05", "q08", "q17"])
def test_hot_keys_are_split_at_run_time(spark, skewed, name):
    for key, setting in SPLIT.items():
        spark.conf.set(key, setting)
    try:
        df = QUERIES[name](spark, skewed)
        df.collect()
        assert "skew=true" in plan(df)
    finally:
        for key in SPLIT:
            spark.conf.unset(key)
