"""Primary and foreign key checks over all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """(columns, rows): references without a target; equal ones are counted before the join."""
    wanted = child.groupBy(*columns).agg(F.count("*").alias("rows"))
    on = [F.col(c) == F.col(f"target_{k}") for c, k in zip(columns, keys)]
    targets = parent.select(*[F.col(k).alias(f"target_{k}") for k in keys]).distinct()
    return wanted.join(targets, on, "left_anti")


def integrity_report(tables) -> DataFrame:
    """(kind, name, violations): repeated keys and orphaned rows per constraint."""
    parts = []
    for name, keys in PRIMARY_KEYS.items():
        parts.append(
            repeated_keys(getattr(tables, name), keys)
            .agg(F.count("*").alias("violations"))
            .select(F.lit("primary key").alias("kind"), F.lit(name).alias("name"), "violations")
        )
    for child, columns, parent in FOREIGN_KEYS:
        lost = orphans(
            getattr(tables, child), columns, getattr(tables, parent), PRIMARY_KEYS[parent]
        )
        parts.append(
            lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")).select(
                F.lit("foreign key").alias("kind"),
                F.lit(f"{child} -> {parent}").alias("name"),
                "violations",
            )
        )
    return reduce(DataFrame.unionByName, parts)
