"""All queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sumtrace.plans import lineitems, orders, sql_variants, stock
from sumtrace.plans.params import params

QUERIES = {
    name: getattr(module, name)
    for module, names in (
        (lineitems, ("q01", "q06", "q14", "q15", "q17", "q19", "q20", "q20_shipped")),
        (orders, ("q03", "q04", "q05", "q07", "q08", "q10", "q12", "q13", "q18", "q21", "q22")),
        (stock, ("q02", "q09", "q11", "q16")),
        (sql_variants, ("q08_sql", "q12_sql", "q13_sql", "q14_sql", "q15_sql")),
    )
    for name in names
}


def answer(tables, name: str, profile: str = "standard", **overrides) -> DataFrame:
    """Run one query; parameters come from a profile and may be overridden."""
    return QUERIES[name](tables, params(name[:3], profile, **overrides))
