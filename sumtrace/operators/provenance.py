"""Reports on the terms behind released values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.exact import exact_sum
from sumtrace.operators.packed import ROW, Packed, PackedTexts, name, packed_texts
from sumtrace.operators.terms import (
    SLOTS,
    function_name,
    operands,
    release_terms,
    released,
    value,
)
from sumtrace.session import cut

TOLERANCE = 1e-4


def listing(terms: DataFrame) -> DataFrame:
    """Terms with their operands and value."""
    named = [c for i in SLOTS for c in (f"var_{i}", f"x_{i}")]
    return terms.select("fn", "row", "shape", *named, value().alias("value"))


def term_text() -> Column:
    """A term as text, such as ``(x8_5_1_2*(100-x9_5_1_2))``."""

    def number(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    pieces = [F.when(F.col("coef") != 1, number(F.col("coef")))]
    for i in SLOTS:
        var, shift, sign = F.col(f"var_{i}"), F.col(f"shift_{i}"), F.col(f"sign_{i}")
        shifted = F.concat(
            F.lit("("), number(shift), F.when(sign == 1, "+").otherwise("-"), var, F.lit(")")
        )
        pieces.append(F.when((shift == 0) & (sign == 1), var).otherwise(shifted))
    return F.concat(F.lit("("), F.concat_ws("*", *pieces), F.lit(")"))


def render(terms: DataFrame | PackedTexts, size: int = 1000) -> DataFrame:
    """Formula text per function, in pieces of about ``size`` terms.

    A function over very many rows gets many pieces; the formula is their sum. Equal
    terms become one with a factor, and terms are spread over pieces by their hash,
    so no piece grows with the table. The struct key spreads the pieces of one
    function over tasks after the join on the function. Packed terms are written once, packed; which
    functions have several pieces is written too, and is little, so that the join need not deal the texts.
    """
    if isinstance(terms, PackedTexts):
        counts = cut(terms.counts)
        several = terms.texts(counts).groupBy("fn").agg(F.ceil(F.count("*") / size).alias("several"))
        several = cut(several.where(F.col("several") > 1))
        texts = terms.texts(counts).join(several, "fn", "left").withColumn("pieces", F.coalesce("several", F.lit(1).cast("bigint")))
        return _pieced(_counted(texts, "pieces"))
    texts = _counted(terms.select("fn", term_text().alias("text")).groupBy("fn", "text").count())
    pieces = texts.groupBy("fn").agg(F.ceil(F.count("*") / size).alias("pieces"))
    return _pieced(texts.join(pieces, "fn"))


def _counted(texts: DataFrame, *more: str) -> DataFrame:
    """Equal terms as one with a factor."""
    return texts.select(
        "fn",
        F.when(F.col("count") == 1, F.col("text"))
        .otherwise(F.concat(F.col("count").cast("string"), F.lit("*"), F.col("text")))
        .alias("text"),
        *more,
    )


def _pieced(texts: DataFrame) -> DataFrame:
    """(fn, piece, pieces, formula) of texts that are to be spread over so many pieces."""
    spread = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("bigint")
    return (
        texts.withColumn("piece", F.pmod(spread, F.col("pieces")))
        .groupBy(F.struct("fn", "piece", "pieces").alias("key"))
        .agg(F.array_sort(F.collect_list("text")).alias("texts"))
        .select(
            "key.*",
            F.concat(F.lit("("), F.array_join("texts", "+"), F.lit(")")).alias("formula"),
        )
    )


def evaluate(tables, query: str, profile: str = "standard") -> DataFrame:
    """Each released value beside the value its terms add up to."""
    sums = (
        release_terms(tables, query, profile, named=False)
        .groupBy("fn")
        .agg(
            exact_sum(value().cast("bigint")).cast("double").alias("total"),
            F.count("*").alias("terms"),
        )
    )
    # A function without terms (an empty branch, an empty table) is zero or null.
    return (
        released(tables, query, profile)
        .join(sums, "fn", "left")
        .select(
            "fn",
            "output",
            "value",
            (F.coalesce("total", F.lit(0.0)) / F.col("unit") / F.col("divisor")).alias("evaluated"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
        )
        .withColumn("abs_err", F.abs(F.col("evaluated") - F.col("value")))
    )


def released_values(tables, names, profile: str = "standard") -> DataFrame:
    """Released (fn, output, value, divisor, unit) of several queries."""
    return reduce(DataFrame.unionByName, [released(tables, n, profile) for n in names])


def evaluation_report(tables, names, profile: str = "standard") -> DataFrame:
    """Per released column: functions, terms, greatest error, and whether all agree."""
    parts = [
        evaluate(tables, n, profile)
        .groupBy("output")
        .agg(
            F.count("*").alias("functions"),
            F.sum("terms").alias("terms"),
            F.round(F.max("abs_err"), 4).alias("max_abs_err"),
            F.bool_and(F.coalesce(F.col("abs_err") <= TOLERANCE, F.lit(True))).alias("agrees"),
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def variables_used(terms: DataFrame | Packed) -> DataFrame:
    """Number of distinct variables per function, and over all functions as ``*``.

    Packed terms (of :func:`packed.occurrence`) have one cell per function and variable.
    """
    if isinstance(terms, Packed):
        used = terms.cells().where("d > 0")
        per_fn = used.groupBy("fn").agg(F.count("*").alias("variables"))
        overall = used.groupBy(*ROW, "tag").agg(F.count("*").alias("n")).agg(F.count("*").alias("variables"))
        return per_fn.unionByName(overall.select(F.lit("*").alias("fn"), "variables"))
    used = operands(terms).select("fn", "var").distinct()
    per_fn = used.groupBy("fn").agg(F.count("*").alias("variables"))
    overall = used.select("var").distinct().agg(F.count("*").alias("variables"))
    return per_fn.unionByName(overall.select(F.lit("*").alias("fn"), "variables"))


def coverage(terms: DataFrame | Packed) -> DataFrame:
    """Per variable: in how many terms and in how many functions it occurs."""
    if isinstance(terms, Packed):
        used = terms.cells().where("d > 0").groupBy(*ROW, "tag")
        used = used.agg(F.sum("d").cast("bigint").alias("terms"), F.count("*").alias("functions"))
        return used.select(name().alias("var"), "terms", "functions")
    return (
        operands(terms)
        .groupBy("var", "fn")
        .agg(F.count("*").alias("n"))
        .groupBy("var")
        .agg(F.sum("n").alias("terms"), F.count("*").alias("functions"))
    )


def released_formulas(tables, names, profile: str = "standard", size: int = 1000) -> DataFrame:
    """(fn, piece, pieces, formula, value): each released value beside the pieces of its formula.

    A formula is the sum of its pieces, however many there are; the value stands beside each. Terms are
    written once and read twice, for the number of pieces and for their texts.
    """
    texts = render(packed_texts(tables, names, profile), size)
    return texts.join(released_values(tables, names, profile).select("fn", "value"), "fn").select(
        "fn", "piece", "pieces", "formula", "value"
    )
