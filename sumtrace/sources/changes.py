"""Refresh streams as files: what stream n inserts and what it deletes.

``orders.tbl.u<n>`` and ``lineitem.tbl.u<n>`` hold the rows of an insert, ``delete.<n>`` one order
key a line. A stream may lie in several numbered pieces (``orders.tbl.u<n>.<k>``, ``delete.u<n>.<k>``)
or in folders of these names. A stream may lack any of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrace.sources.schemas import SCHEMAS
from sumtrace.sources.tables import in_hundredths, matching, read_text, write_text

UPDATES = ".u[0-9]*"
DELETES = "delete.{[0-9]*,u[0-9]*}"


class Changes(NamedTuple):
    """Each with its column ``stream``."""

    orders: DataFrame
    lines: DataFrame
    deletes: DataFrame  # (orderkey, stream)


def _stream(name: str) -> Column:
    """Number of the stream that a file or the folder it lies in is named after."""
    path = F.col("_metadata.file_path")
    return F.regexp_extract(path, rf"^.*/{name}u?([0-9]+)(\.[0-9]+)?(/[^/]*)?$", 1).cast("int").alias("stream")


def _inserted(spark: SparkSession, folder: str, name: str, money_scale: int) -> DataFrame:
    if not matching(spark, f"{folder}/{name}.tbl{UPDATES}"):
        return in_hundredths(spark.createDataFrame([], f"{SCHEMAS[name]}, stream INT"), name, money_scale)
    rows = read_text(spark, folder, name, UPDATES)
    return in_hundredths(rows.select("*", _stream(rf"{name}\.tbl\.")), name, money_scale)


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    if not matching(spark, f"{folder}/{DELETES}"):
        return spark.createDataFrame([], "orderkey BIGINT, stream INT")
    key = F.rtrim(F.trim("value"), F.lit("|"))
    wrong = F.raise_error(F.concat(F.lit("not an order key: "), F.col("value"))).cast("bigint")
    lines = spark.read.text(f"{folder}/{DELETES}").select("value", _stream(r"delete\."))
    return lines.where(F.trim("value") != "").select(
        F.when(key.rlike("^[0-9]+$"), key.cast("bigint")).otherwise(wrong).alias("orderkey"), "stream"
    )


def read_changes(spark: SparkSession, folder: str, money_scale: int = 1) -> Changes:
    """All streams in ``folder``; a malformed line fails the read."""
    tables = (_inserted(spark, folder, name, money_scale) for name in ("orders", "lineitem"))
    return Changes(*tables, _deleted(spark, folder))


def write_changes(folder: str, stream: int, orders: DataFrame, lines: DataFrame, keys: DataFrame) -> None:
    """One stream: rows to insert, and ``keys(orderkey)`` to delete after that."""
    write_text(orders, "orders", folder, f".u{stream}")
    write_text(lines, "lineitem", folder, f".u{stream}")
    keys.select(F.col("orderkey").cast("string").alias("value")).write.mode("overwrite").text(f"{folder}/delete.{stream}")
