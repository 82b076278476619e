import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sumtrace.session import local_session  # noqa: E402
from sumtrace.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


def attach(folder):
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        path = f"{folder}/{file}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


@pytest.fixture(scope="session")
def db():
    return attach(SMALL)


def term_rows(spark, rows):
    """Terms from (fn, row, shape, coef, factors); a factor is (var, x[, shift, sign, power])."""
    flat = []
    for fn, row, shape, coef, factors in rows:
        cells = [fn, row, shape, float(coef)]
        for i in range(3):
            f = factors[i] if i < len(factors) else (None, None)
            var, x, shift, sign, power = (*f, *(0, 1, 1)[len(f) - 2 :])
            cells += [var, None if x is None else float(x), float(shift), float(sign), power]
        flat.append(tuple(cells))
    slots = ", ".join(
        f"var_{i} string, x_{i} double, shift_{i} double, sign_{i} double, pow_{i} int"
        for i in (1, 2, 3)
    )
    return spark.createDataFrame(flat, f"fn string, row string, shape string, coef double, {slots}")
