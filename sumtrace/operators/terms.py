"""Formulas as rows: one row per released function and contributing term.

A term is ``coef * f1 * f2 * f3`` and a factor is ``(shift + sign * x) ^ pow`` over
one hidden value ``x``. A released function is the sum of its terms, divided by a
constant. Values and derivatives are closed-form column expressions; no formula
text is built or parsed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.variables import row_part, variable
from sumtrace.plans import lineitems, orders, stock
from sumtrace.plans.catalog import answer
from sumtrace.plans.params import params

SLOTS = (1, 2, 3)


@dataclass(frozen=True)
class Factor:
    tag: str
    table: str
    column: str
    shift: int = 0
    sign: int = 1


@dataclass(frozen=True)
class Term:
    factors: tuple[Factor, ...]
    coef: int = 1


@dataclass(frozen=True)
class Output:
    """One released column: its terms, implied decimals and divisor (a number or a column)."""

    name: str
    terms: tuple[Term, ...]
    digits: int = 0
    divisor: int | str = 1
    where: str | None = None  # boolean column of the rows; other rows contribute nothing
    limited: bool = False  # only rows whose key is in the answer


@dataclass(frozen=True)
class Release:
    """A query that releases functions: its contributing rows and released columns."""

    rows: Callable
    outputs: tuple[Output, ...]
    keys: tuple[str, ...] = ()
    answer_keys: tuple[str, ...] | None = None
    tables: tuple[str, ...] = field(default=("lineitem",))


QTY = Factor("x7", "lineitem", "l_quantity")
PRICE = Factor("x8", "lineitem", "l_extendedprice")
DISC = Factor("x9", "lineitem", "l_discount")
LESS_DISC = Factor("x9", "lineitem", "l_discount", 100, -1)
PLUS_TAX = Factor("x10", "lineitem", "l_tax", 100, 1)
AVAIL = Factor("x3", "partsupp", "ps_availqty")
COST = Factor("x4", "partsupp", "ps_supplycost")
BALANCE = Factor("x5", "customer", "c_acctbal")

DISC_PRICE = (Term((PRICE, LESS_DISC)),)
CHARGE = (Term((PRICE, LESS_DISC, PLUS_TAX)),)
PROFIT = (Term((PRICE, LESS_DISC)), Term((COST, QTY), -100))


def _one(*factors: Factor) -> tuple[Term, ...]:
    return (Term(factors),)


RELEASES = {
    "q01": Release(
        lineitems.q01_rows,
        (
            Output("sum_qty", _one(QTY)),
            Output("sum_base_price", _one(PRICE), 2),
            Output("sum_disc_price", DISC_PRICE, 4),
            Output("sum_charge", CHARGE, 6),
            Output("avg_qty", _one(QTY), 0, "count_order"),
            Output("avg_price", _one(PRICE), 2, "count_order"),
            Output("avg_disc", _one(DISC), 2, "count_order"),
        ),
        ("l_returnflag", "l_linestatus"),
    ),
    "q03": Release(
        orders.q03_rows, (Output("revenue", DISC_PRICE, 4, limited=True),), ("l_orderkey",)
    ),
    "q05": Release(orders.q05_rows, (Output("revenue", DISC_PRICE, 4),), ("n_name",)),
    "q06": Release(lineitems.q06_rows, (Output("revenue", _one(PRICE, DISC), 4),)),
    "q07": Release(
        orders.q07_rows,
        (Output("revenue", DISC_PRICE, 4),),
        ("supp_nation", "cust_nation", "l_year"),
    ),
    "q08": Release(
        orders.q08_rows,
        (
            Output("nation_volume", DISC_PRICE, 4, where="is_nation"),
            Output("total_volume", DISC_PRICE, 4),
        ),
        ("o_year",),
    ),
    "q09": Release(
        stock.q09_rows,
        (Output("sum_profit", PROFIT, 4),),
        ("nation", "o_year"),
        tables=("lineitem", "partsupp"),
    ),
    "q10": Release(
        orders.q10_rows,
        (Output("revenue", DISC_PRICE, 4, limited=True),),
        ("o_custkey",),
        ("c_custkey",),
    ),
    "q11": Release(
        stock.q11_rows,
        (
            Output("value", _one(COST, AVAIL), 2, limited=True),
            Output("total_value", _one(COST, AVAIL), 2),
        ),
        ("ps_partkey",),
        tables=("partsupp",),
    ),
    "q14": Release(
        lineitems.q14_rows,
        (
            Output("promo_value", DISC_PRICE, 4, where="is_promo"),
            Output("total_value", DISC_PRICE, 4),
        ),
    ),
    "q15": Release(
        lineitems.q15_rows,
        (Output("total_revenue", DISC_PRICE, 4, limited=True),),
        ("l_suppkey",),
        ("s_suppkey",),
    ),
    "q17": Release(lineitems.q17_rows, (Output("avg_yearly", _one(PRICE), 2, 7),)),
    "q18": Release(
        orders.q18_rows,
        (Output("sum_quantity", _one(QTY), limited=True),),
        ("l_orderkey",),
        ("o_orderkey",),
    ),
    "q19": Release(lineitems.q19_rows, (Output("revenue", DISC_PRICE, 4),)),
    "q20_shipped": Release(
        lineitems.q20_rows, (Output("sum_quantity", _one(QTY)),), ("l_partkey", "l_suppkey")
    ),
    "q22": Release(
        orders.q22_rows,
        (Output("totacctbal", _one(BALANCE), 2),),
        ("cntrycode",),
        tables=("customer",),
    ),
}

# q11's total is one function; every reported part repeats its value.
GLOBAL_OUTPUTS = {("q11", "total_value")}


def function_name(query: str, output: str, keys: tuple[str, ...]) -> Column:
    """Name of a released function: query, column and group key."""
    if (query, output) in GLOBAL_OUTPUTS:
        keys = ()
    return F.concat_ws(
        "|", F.lit(f"{query}.{output}"), *[F.col(k).cast("string") for k in keys]
    )


def shape(term: Term) -> str:
    """The term with its tags instead of its variables."""
    return "*".join([str(term.coef), *[_factor_text(f, f.tag) for f in term.factors]])


def _factor_text(f: Factor, name: str) -> str:
    if f.shift == 0 and f.sign == 1:
        return name
    return f"({f.shift}{'+' if f.sign == 1 else '-'}{name})"


def _term_struct(query: str, release: Release, output: Output, term: Term) -> Column:
    main = release.tables[0]
    fields = [
        function_name(query, output.name, release.keys).alias("fn"),
        F.col(f"row_{main}").alias("row"),
        F.lit(shape(term)).alias("shape"),
        F.lit(float(term.coef)).alias("coef"),
    ]
    for i in SLOTS:
        f = term.factors[i - 1] if i <= len(term.factors) else None
        fields += slot(
            i,
            variable(f.tag, f"row_{f.table}") if f else F.lit(None).cast("string"),
            F.col(f.column).cast("double") if f else F.lit(None).cast("double"),
            f.shift if f else 0,
            f.sign if f else 1,
        )
    whole = F.struct(*fields)
    if output.where:
        whole = F.when(F.col(output.where), whole)
    if output.limited:
        whole = F.when(F.col("reported"), whole)
    return whole


def slot(i: int, var: Column, x: Column, shift=0.0, sign=1.0, power=1) -> list[Column]:
    """The five columns of one factor."""
    return [
        var.alias(f"var_{i}"),
        x.alias(f"x_{i}"),
        F.lit(float(shift)).alias(f"shift_{i}"),
        F.lit(float(sign)).alias(f"sign_{i}"),
        (F.lit(power) if isinstance(power, int) else power).cast("int").alias(f"pow_{i}"),
    ]


def release_terms(
    tables, query: str, profile: str = "standard", named: bool = True
) -> DataFrame:
    """All terms of all functions that one query releases, in one pass over its rows.

    Without ``named`` rows and variables stay without names, which evaluation does
    not need.
    """
    release = RELEASES[query]
    rows = contributing(tables, query, profile)
    no_name = F.lit(None).cast("string")
    rows = rows.withColumns(
        {f"row_{name}": row_part(name) if named else no_name for name in release.tables}
    )
    structs = [
        _term_struct(query, release, o, term) for o in release.outputs for term in o.terms
    ]
    whole = F.array(*structs)
    if any(o.where or o.limited for o in release.outputs):
        whole = F.filter(whole, lambda s: s.isNotNull())
    return rows.select(F.inline(whole))


def contributing(tables, query: str, profile: str = "standard") -> DataFrame:
    """The rows behind one query's functions; ``reported`` tells which are in a limited answer."""
    release = RELEASES[query]
    p = params(query[:3], profile)
    rows = release.rows(tables, p)
    limited = [o for o in release.outputs if o.limited]
    if limited:
        names = release.answer_keys or release.keys
        released = answer(tables, query, profile).select(
            *[F.col(a).alias(f"released_{i}") for i, a in enumerate(names)]
        )
        on = [F.col(k) == F.col(f"released_{i}") for i, k in enumerate(release.keys)]
        if len(limited) == len(release.outputs):
            rows = rows.join(released, on, "left_semi").withColumn("reported", F.lit(True))
        else:
            rows = rows.join(released, on, "left").withColumn(
                "reported", F.col("released_0").isNotNull()
            )
    return rows


def terms(tables, names, profile: str = "standard") -> DataFrame:
    """Terms of several queries together."""
    frames = [release_terms(tables, n, profile) for n in names]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def _base(i: int) -> Column:
    return F.col(f"shift_{i}") + F.col(f"sign_{i}") * F.col(f"x_{i}")


def _power(base: Column, exponent: Column) -> Column:
    return F.when(exponent == 1, base).when(exponent == 0, 1.0).otherwise(F.pow(base, exponent))


def _factor(i: int) -> Column:
    return F.coalesce(_power(_base(i), F.col(f"pow_{i}")), F.lit(1.0))


def value() -> Column:
    """The value of a term at the hidden data."""
    whole = F.col("coef")
    for i in SLOTS:
        whole = whole * _factor(i)
    return whole


def partials(terms: DataFrame) -> DataFrame:
    """(fn, var, d): one row per term and operand, d the derivative of the term."""
    entries = []
    for i in SLOTS:
        n = F.col(f"pow_{i}")
        d = F.col("coef") * F.col(f"sign_{i}") * n * _power(_base(i), n - 1)
        for j in SLOTS:
            if j != i:
                d = d * _factor(j)
        entries.append(F.struct(F.col(f"var_{i}").alias("var"), d.alias("d")))
    return (
        terms.select("fn", F.explode(F.array(*entries)).alias("e"))
        .select("fn", "e.var", "e.d")
        .where(F.col("var").isNotNull())
    )


def operands(terms: DataFrame) -> DataFrame:
    """(fn, row, var): one row per term and operand."""
    names = F.array(*[F.col(f"var_{i}") for i in SLOTS])
    return terms.select("fn", "row", F.explode(names).alias("var")).where(
        F.col("var").isNotNull()
    )


def released(tables, query: str, profile: str = "standard") -> DataFrame:
    """(fn, value, divisor, digits): the released values of one query."""
    release = RELEASES[query]
    keys = release.answer_keys or release.keys
    entries = [
        F.struct(
            function_name(query, o.name, keys).alias("fn"),
            F.lit(f"{query}.{o.name}").alias("output"),
            F.col(o.name).alias("value"),
            (F.col(o.divisor) if isinstance(o.divisor, str) else F.lit(o.divisor))
            .cast("double")
            .alias("divisor"),
            F.lit(tables.unit(o.digits)).alias("unit"),
        )
        for o in release.outputs
    ]
    df = answer(tables, query, profile).select(F.inline(F.array(*entries)))
    if any(q == query for q, _ in GLOBAL_OUTPUTS):
        df = df.dropDuplicates(["fn"])
    return df
