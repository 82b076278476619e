"""Gradient descent on released equations, the attack that the audit is compared with.

The unknowns start near zero. Every round evaluates all functions at the current
guess, sums the squared residuals, and moves each unknown against its gradient.
A round is joins and sums over the terms; only the loss and the gradient's norm
reach the driver.

:func:`descend` moves by the gradient at a small rate. :func:`solve` goes on until the equations hold or
nothing falls any more: each round takes the shortest step that solves the equations' linear part
(Gauss-Newton), found by conjugate gradients, and halves it until the loss falls.
Every round is written with its loss, so a run that was broken off goes on from its last round.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.operators.terms import SLOTS, partials, value
from sumtrace.session import cut, scratch, uncut
from sumtrace.sources.tables import matching

# Fixed values of the method.
RATE = 0.001
CLIP_NORM = 1.0
CLIP_VALUE = 10.0
CLIP_POWER = 100.0
START = 0.1
UNSTABLE = 1e10

# A step is good enough when a hundredth of the slope is left, or after so many rounds of its own.
FORCING = 0.01
INNER = 30
HALVINGS = 12
# The loss falls no more when it keeps this share of itself.
LEAST_FALL = 1e-3


def rescaled(terms: DataFrame, units: dict[str, float]) -> DataFrame:
    """The same terms over unknowns measured in units of their own, per tag."""
    scaled = terms
    for i in SLOTS:
        tag = F.substring_index(F.col(f"var_{i}"), "_", 1)
        unit = F.coalesce(
            *[F.when(tag == t, F.lit(float(u))) for t, u in units.items()], F.lit(1.0)
        )
        scaled = scaled.withColumns(
            {
                "coef": F.col("coef") * F.pow(unit, F.col(f"pow_{i}")),
                f"shift_{i}": F.col(f"shift_{i}") / unit,
                f"x_{i}": F.col(f"x_{i}") / unit,
            }
        )
    return scaled


def start_values(terms: DataFrame, attempt: int = 0) -> DataFrame:
    """(var, x): a guess in [-0.1, 0.1) that depends on the name only."""
    names = terms.select(F.explode(F.array(*[F.col(f"var_{i}") for i in SLOTS])).alias("var"))
    digest = F.md5(F.concat(F.col("var"), F.lit(f"#{attempt}")))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return (
        names.where(F.col("var").isNotNull())
        .distinct()
        .withColumn("x", share * (2 * START) - START)
    )


def _at(terms: DataFrame, state: DataFrame) -> DataFrame:
    """The terms with the current guess in place of the hidden values."""
    for i in SLOTS:
        guess = state.select(F.col("var").alias(f"var_{i}"), F.col("x").alias(f"guess_{i}"))
        x = F.col(f"guess_{i}")
        held = F.greatest(F.least(x, F.lit(CLIP_POWER)), F.lit(-CLIP_POWER))
        terms = (
            terms.join(guess, f"var_{i}", "left")
            .withColumn(f"x_{i}", F.when(F.col(f"pow_{i}") > 1, held).otherwise(x))
            .drop(f"guess_{i}")
        )
    return terms


def residuals(terms: DataFrame, targets: DataFrame) -> DataFrame:
    """(fn, f): value of each equation at the terms' values, less its target."""
    sums = terms.groupBy("fn").agg(F.sum(value()).alias("total"))
    return sums.join(targets, "fn").select("fn", (F.col("total") - F.col("target")).alias("f"))


def _clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(CLIP_VALUE)), F.lit(-CLIP_VALUE))


def descend(
    terms: DataFrame,
    targets: DataFrame,
    rounds: int,
    tol: float = 1e-6,
    rate: float = RATE,
) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """Final (var, x) and the history of (round, loss, gradient norm)."""
    terms = cut(terms)
    targets = cut(targets)
    state = cut(start_values(terms))
    history = []
    for n in range(rounds):
        here = _at(terms, state)
        off = cut(residuals(here, targets))
        loss = off.agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0.0
        if not math.isfinite(loss) or loss > UNSTABLE:
            history.append((n, UNSTABLE, 0.0))
            state = cut(start_values(terms, attempt=n + 1))
            continue
        pull = cut(
            partials(here)
            .join(off, "fn")
            .groupBy(F.struct("var").alias("key"))
            .agg(F.sum(2 * F.col("f") * F.col("d")).alias("g"))
            .select("key.var", "g")
        )
        norm = math.sqrt(pull.agg(F.sum(F.col("g") * F.col("g"))).first()[0] or 0.0)
        history.append((n, loss, norm))
        step = rate * min(1.0, CLIP_NORM / norm) if norm else 0.0
        old = [off, pull, state]
        state = cut(
            state.join(pull, "var", "left").select(
                "var", _clipped(F.col("x") - step * F.coalesce("g", F.lit(0.0))).alias("x")
            )
        )
        uncut(*old)
        if loss < tol:
            break
    return state, history


class Solution(NamedTuple):
    state: DataFrame  # (var, x)
    residuals: DataFrame  # (fn, f)
    history: list[tuple[int, float]]  # (round, loss)


def _product(jac: DataFrame, vector: DataFrame, on: str, out: str, column: str) -> DataFrame:
    """(out, w): sums of ``d`` times ``column`` over the matrix, joined with the vector on ``on``."""
    joined = jac.join(vector.select(on, column), on)
    return joined.groupBy(F.struct(out).alias("key")).agg(F.sum(F.col("d") * F.col(column)).alias("w")).select(f"key.{out}", "w")


def shortest_step(jac: DataFrame, off: DataFrame) -> DataFrame:
    """(var, w): of the steps along ``jac(fn, var, d)`` that bring ``off(fn, f)`` closest to zero the
    shortest, or nearly.

    Conjugate gradients on the normal equations from zero, so equations may contradict or repeat one
    another. Only sums over all functions or variables reach the driver.
    """

    def squared(rows: DataFrame, column: str) -> float:
        return rows.agg(F.sum(F.col(column) * F.col(column))).first()[0] or 0.0

    left = off.select("fn", (-F.col("f")).alias("r"))
    spent = [cut(_product(jac, left, "fn", "var", "r"))]
    slope = first = squared(spent[0], "w")
    step = spent[0].select("var", F.col("w").alias("p"), F.lit(0.0).alias("x"))
    for _ in range(INNER):
        if not slope or slope <= FORCING**2 * first:
            break
        along = _product(jac, step, "var", "fn", "p")
        spent.append(cut(left.join(along, "fn", "left").select("fn", "r", F.coalesce("w", F.lit(0.0)).alias("q"))))
        length = squared(spent[-1], "q")
        if not length:
            break
        share = slope / length
        left = spent[-1].select("fn", (F.col("r") - share * F.col("q")).alias("r"))
        spent.append(cut(step.join(_product(jac, left, "fn", "var", "r"), "var")))
        new = squared(spent[-1], "w")
        step = spent[-1].select(
            "var", (F.col("w") + new / slope * F.col("p")).alias("p"), (F.col("x") + share * F.col("p")).alias("x")
        )
        slope = new
    out = cut(step.select("var", F.col("x").alias("w")))
    uncut(*spent)
    return out


def _loss(off: DataFrame) -> float:
    return off.agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0.0


def _off(terms: DataFrame, state: DataFrame, targets: DataFrame) -> tuple[DataFrame, float]:
    off = cut(residuals(_at(terms, state), targets))
    return off, _loss(off)


def solve(terms: DataFrame, targets: DataFrame, tol: float = 1e-6, folder: str | None = None) -> Solution:
    """Values at which the equations hold (loss below ``tol``), or from which the loss falls no more.

    Round n is in ``folder``/round=n; with rounds from before the last whole one is gone on from.
    Without equations there is nothing to do and the start values come out. An equation without
    unknowns keeps its residual and the others are solved.
    """
    spark = terms.sparkSession
    terms, targets = cut(terms), cut(targets)
    folder = folder or scratch(spark)

    def round_(n: int) -> DataFrame:
        return spark.read.schema("var STRING, x DOUBLE").parquet(f"{folder}/round={n}")

    whole = [int(p.rsplit("=", 1)[1].split("/")[0]) for p in matching(spark, f"{folder}/round=*/_SUCCESS")]
    n = max(whole, default=0)
    if not whole:
        start_values(terms).write.mode("overwrite").parquet(f"{folder}/round=0")
    state = round_(n)
    off, loss = _off(terms, state, targets)
    history = [(n, loss)]
    while loss >= tol:
        partial = partials(_at(terms, state)).groupBy(F.struct("fn", "var").alias("key")).agg(F.sum("d").alias("d"))
        jac = cut(partial.select("key.fn", "key.var", "d"))
        step = shortest_step(jac, off)
        uncut(jac)
        for k in range(HALVINGS + 1):
            moved = F.col("x") + 0.5**k * F.coalesce("w", F.lit(0.0))
            tried = cut(state.join(step, "var", "left").select("var", moved.alias("x")))
            new_off, new_loss = _off(terms, tried, targets)
            falls = math.isfinite(new_loss) and new_loss < (1 - LEAST_FALL) * loss
            if falls:
                break
            uncut(tried, new_off)
        uncut(step)
        if not falls:
            break
        n += 1
        tried.write.mode("overwrite").parquet(f"{folder}/round={n}")
        uncut(tried, off, state)  # rounds in a folder of the caller's stay
        state, off, loss = round_(n), new_off, new_loss
        history.append((n, loss))
    return Solution(state, off, history)
