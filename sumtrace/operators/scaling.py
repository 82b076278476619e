"""How the audit and the gradient descent scale, on random functions.

    python -m sumtrace.operators.scaling audit 1000 100
    python -m sumtrace.operators.scaling descent 1000 100 20
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrace.operators.determined import determined
from sumtrace.operators.jacobian import jacobian
from sumtrace.operators.reconstruct import descend
from sumtrace.operators.terms import slot
from sumtrace.session import cut, local_session


def _draw(seed: int, what: str, bound: int) -> Column:
    """A number below ``bound`` fixed by the row, so recomputed rows agree."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "fn", "row"), F.lit(bound))


def random_terms(spark: SparkSession, variables: int, functions: int, seed: int = 42) -> DataFrame:
    """``functions`` sums of ``variables`` random terms each, every term times two.

    A term is x, (x+1)(y+1), (x+1)(y+1)(z+1) or (x+1)/(y+1), with equal chance.
    """
    ids = spark.range(functions * variables).select(
        F.format_string("f.%d", (F.col("id") / variables).cast("bigint")).alias("fn"),
        F.format_string("t%d", F.col("id") % variables).alias("row"),
    )
    kind = _draw(seed, "kind", 4)
    cols = []
    for i in (1, 2, 3):
        pick = _draw(seed, f"v{i}", variables)
        used = {1: F.lit(True), 2: kind > 0, 3: kind == 2}[i]
        var = F.when(used, F.concat(F.lit("x_"), pick.cast("string")))
        x = F.when(
            used, F.pmod(F.xxhash64(F.lit(seed), F.lit("x"), pick), F.lit(1 << 30)) / float(1 << 30)
        )
        power = F.when((kind == 3) & F.lit(i == 2), -1).otherwise(1)
        cols += slot(i, var, x, 1, 1, power)
        if i == 1:
            cols[2] = F.when(kind == 0, 0.0).otherwise(1.0).alias("shift_1")
    return ids.select("fn", "row", F.lit("random").alias("shape"), F.lit(2.0).alias("coef"), *cols)


def measure(spark: SparkSession, variables: int, functions: int, seed: int = 42) -> dict:
    """Seconds for the derivative and for the check."""
    terms = cut(random_terms(spark, variables, functions, seed))
    start = time.monotonic()
    jac = cut(jacobian(terms))
    derived = time.monotonic()
    found = determined(jac).count()
    return {
        "variables": variables,
        "functions": functions,
        "derive_seconds": derived - start,
        "check_seconds": time.monotonic() - derived,
        "determined": found,
    }


# Coefficients lie in +-0.1, of products +-0.01, of powers +-0.001.
COEFFICIENT = {"linear": 0.1, "cross": 0.01, "power": 0.001}


def random_equations(spark: SparkSession, unknowns: int, equations: int, seed: int = 42) -> DataFrame:
    """Equations ``f = 0`` with every unknown once, and up to half as many products and powers."""

    def part(kind: str, per_equation: int) -> DataFrame:
        rows = spark.range(equations * per_equation).select(
            F.format_string("e.%d", (F.col("id") / per_equation).cast("bigint")).alias("fn"),
            F.format_string(f"{kind}%d", F.col("id") % per_equation).alias("row"),
            (F.col("id") % per_equation).alias("n"),
        )
        if kind != "linear":
            # how many of its possible terms an equation has
            many = F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), "fn"), F.lit(per_equation + 1))
            rows = rows.where(F.col("n") < many)
        span = COEFFICIENT[kind]
        share = _draw(seed, f"{kind} coefficient", 1 << 30) / float(1 << 30)
        first = F.col("n") if kind == "linear" else _draw(seed, f"{kind} 1", unknowns)
        # another unknown than the first
        second = F.pmod(first + 1 + _draw(seed, "cross 2", unknowns - 1), F.lit(unknowns))
        power = _draw(seed, "exponent", 2) + 2 if kind == "power" else 1

        def name(index: Column) -> Column:
            return F.concat(F.lit("x_"), index.cast("string"))

        none, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
        return rows.select(
            "fn",
            "row",
            F.lit(kind).alias("shape"),
            F.round(share * 2 * span - span, 3).alias("coef"),
            *slot(1, name(first), zero, power=power),
            *slot(2, name(second) if kind == "cross" else none, zero),
            *slot(3, none, zero),
        )

    whole = part("linear", unknowns)
    for kind in ("cross", "power"):
        whole = whole.unionByName(part(kind, max(unknowns // 2, 1)))
    return whole


def measure_descent(
    spark: SparkSession, unknowns: int, equations: int, rounds: int, seed: int = 42
) -> dict:
    """Seconds for a number of rounds of gradient descent, and the loss reached."""
    terms = cut(random_equations(spark, unknowns, equations, seed))
    targets = terms.select("fn").distinct().withColumn("target", F.lit(0.0))
    start = time.monotonic()
    _, history = descend(terms, targets, rounds)
    return {
        "unknowns": unknowns,
        "equations": equations,
        "rounds": len(history),
        "loss": history[-1][1],
        "seconds": time.monotonic() - start,
    }


if __name__ == "__main__":
    study = {"audit": measure, "descent": measure_descent}[sys.argv[1]]
    print(study(local_session(), *[int(a) for a in sys.argv[2:]]))
