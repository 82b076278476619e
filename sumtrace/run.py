"""Run queries over a folder of tables and write results and timings.

    python -m sumtrace.run TABLES [--query q03] [--out FOLDER] [--times FOLDER]
                           [--format text] [--money-scale 100] [--profile standard]
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession

from sumtrace.plans.catalog import answer
from sumtrace.session import tune
from sumtrace.sources.results import show_result, write_result
from sumtrace.sources.tables import Tables

log = logging.getLogger("sumtrace")

# q20 has two results: the shipped quantities and the suppliers.
RESULTS = {f"q{n:02d}": [f"q{n:02d}"] for n in range(1, 23)} | {"q20": ["q20_shipped", "q20"]}


def run_queries(
    tables: Tables, names: list[str], out: str | None = None, profile: str = "standard"
) -> list[tuple[str, str, float]]:
    """(query, status, seconds) per query; a query that fails is logged and skipped."""
    done = []
    for name in names:
        start = time.monotonic()
        status = "ok"
        try:
            for index, result in enumerate(RESULTS[name]):
                df = answer(tables, result, profile)
                if out:
                    write_result(df, out, name, index)
                else:
                    show_result(df)
        except Exception:
            log.exception("query %s failed", name)
            status = "failed"
        done.append((name, status, time.monotonic() - start))
    return done


def timings(spark: SparkSession, done: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(done, "query STRING, status STRING, seconds DOUBLE")


def append_timings(spark: SparkSession, done: list[tuple[str, str, float]], path: str) -> None:
    timings(spark, done).coalesce(1).write.mode("append").option("sep", "\t").option(
        "header", True
    ).csv(path)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("tables")
    args.add_argument("--query", choices=sorted(RESULTS), help="one query; all without it")
    args.add_argument("--out", help="folder for results; shown on the console without it")
    args.add_argument("--times", help="folder to which timings are appended")
    args.add_argument("--format", default="parquet", choices=["parquet", "text"])
    args.add_argument("--money-scale", type=int, default=1, choices=[1, 100])
    args.add_argument("--profile", default="standard", choices=["standard", "small"])
    a = args.parse_args(argv)
    spark = tune(SparkSession.builder.appName("sumtrace").getOrCreate())
    tables = Tables(spark, a.tables, a.format, a.money_scale)
    done = run_queries(tables, [a.query] if a.query else sorted(RESULTS), a.out, a.profile)
    if a.times:
        append_timings(spark, done, a.times)


if __name__ == "__main__":
    main()
