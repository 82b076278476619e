"""Released terms packed by the table row that they come from.

All terms of one table row and release differ by nothing but the output that they belong to. So a row
is dealt once, by the numbers in its name, with what it adds to every output; names of functions and
variables are only made behind the shuffle. Whatever is asked per variable (its column, the functions
that it is in) is found where the row lies, without dealing anything again.

``sums`` has a row per table row, family and group key: ``k1`` to ``k3`` are the numbers in the row's name (those that
are null left out, as in names), ``q`` is the family (a release and one of its tables), ``keys`` is the end of
the function's name, ``s`` are the sums that the family's cells take. ``spec`` lists the cells of each family
as a constant: query, output, tag and which of the sums.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.functions.variables import row_part, row_parts
from sumtrace.operators.terms import GLOBAL_OUTPUTS, RELEASES, Factor, Output, Release, Term, contributing

ROW = ["k1", "k2", "k3"]


@dataclass(frozen=True)
class Packed:
    sums: DataFrame
    spec: Column

    def cells(self) -> DataFrame:
        """(k1, k2, k3, tag, query, fn, d): one row per function and variable."""
        each = self.sums.select(*ROW, "keys", "s", F.explode(F.get(self.spec, F.col("q"))).alias("e"))
        return each.select(
            *ROW, "e.tag", "e.query", F.concat("e.output", "keys").alias("fn"), F.get("s", F.col("e.at")).alias("d")
        )

    def by_row(self, least: float) -> DataFrame:
        """(k1, k2, k3, cells): the cells (tag, fn, d) with \\|d\\| > ``least`` of each table row.

        A row is in a few groups of each release, so its cells are a short list.
        """
        parts = self.sums.groupBy(*ROW).agg(F.collect_list(F.struct("q", "keys", "s")).alias("parts"))

        def cells(p: Column) -> Column:
            return F.transform(
                F.get(self.spec, p["q"]),
                lambda e: F.struct(e["tag"].alias("tag"), F.concat(e["output"], p["keys"]).alias("fn"), F.get(p["s"], e["at"]).alias("d")),
            )

        whole = F.flatten(F.transform("parts", cells))
        return parts.select(*ROW, F.filter(whole, lambda c: F.abs(c["d"]) > least).alias("cells"))


MARKS = ("\u0001", "\u0002")  # where the names of a term's table rows stand in its text


@dataclass(frozen=True)
class PackedTexts:
    """(row, other, q, keys, s): how often each pair of table rows adds its terms to a group's outputs."""

    counts: DataFrame
    spec: Column

    def texts(self, counts: DataFrame) -> DataFrame:
        """(fn, text, count): the different terms of each function."""
        each = counts.select("row", "other", "keys", "s", F.explode(F.get(self.spec, F.col("q"))).alias("e"))
        text = F.replace(F.replace("e.text", F.lit(MARKS[0]), F.col("row")), F.lit(MARKS[1]), F.col("other"))
        each = each.select(F.concat("e.output", "keys").alias("fn"), text.alias("text"), F.get("s", F.col("e.at")).alias("count"))
        return each.where("count > 0")


def name(tag: str = "tag") -> Column:
    """The name of a variable."""
    return F.concat(F.lit("x"), F.col(tag).cast("string"), F.lit("_"), F.concat_ws("_", *[F.col(k).cast("string") for k in ROW]))


def _numbers(table: str) -> list[Column]:
    """The parts of a row's name, nulls moved to the end: equal for rows of equal names."""
    parts = [c.cast("bigint") for c in row_parts(table)]
    a, b, c = parts + [F.lit(None).cast("bigint")] * (3 - len(parts))
    second = F.when(a.isNotNull(), F.coalesce(b, c)).when(b.isNotNull(), c)
    third = F.when(a.isNotNull() & b.isNotNull(), c)
    return [k.alias(n) for k, n in zip((F.coalesce(a, b, c), second, third), ROW)]


def _base(f: Factor) -> Column:
    return F.coalesce(F.lit(float(f.shift)) + F.lit(float(f.sign)) * F.col(f.column).cast("double"), F.lit(1.0))


def derivative(term: Term, i: int) -> tuple:
    """What a term adds to the derivative by its factor ``i``: a number and the other factors."""
    return (term.coef * term.factors[i].sign, tuple(f for j, f in enumerate(term.factors) if j != i))


def occurrence(term: Term, i: int) -> tuple:
    """One for each term that a variable is in."""
    return (1, ())


def _amount(parts: tuple) -> Column:
    products = [reduce(lambda a, f: a * _base(f), factors, F.lit(float(coef))) for coef, factors in parts]
    return reduce(lambda a, b: a + b, products)


def _cells(outputs: list[Output], table: str, measure) -> dict[tuple, list[tuple[str, int]]]:
    """What is summed for a table's variables, each with the (output, tag) that it is the sum of."""
    found: dict[tuple, list[tuple[str, int]]] = {}
    for o in outputs:
        by_tag: dict[str, list] = {}
        for term in o.terms:
            for i, f in enumerate(term.factors):
                if f.table == table:
                    by_tag.setdefault(f.tag, []).append(measure(term, i))
        for tag, parts in by_tag.items():
            found.setdefault((o.where, o.limited, tuple(parts)), []).append((o.name, int(tag[1:])))
    return found


def packed(tables, names, profile: str = "standard", measure=derivative) -> Packed:
    """The terms of several queries, packed; ``measure`` tells what is summed per function and variable."""
    frames, spec = [], []
    for query in names:
        release = RELEASES[query]
        rows = contributing(tables, query, profile)
        for whole in (False, True):
            outputs = [o for o in release.outputs if ((query, o.name) in GLOBAL_OUTPUTS) == whole]
            keys = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in (() if whole else release.keys)])
            for table in release.tables:
                cells = _cells(outputs, table, measure)
                if not cells:
                    continue
                sums = []
                for at, (where, limited, parts) in enumerate(cells):
                    amount = _amount(parts)
                    for condition in [where] * bool(where) + ["reported"] * limited:
                        amount = F.when(F.col(condition), amount)
                    sums.append(amount.alias(f"s{at}"))
                frame = rows.select(*_numbers(table), keys.alias("keys"), *sums)
                if table != release.tables[0]:
                    # very many rows may share a row of this table: summed before they are dealt
                    frame = frame.groupBy(*ROW, "keys").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))])
                frames.append(frame.withColumn("q", F.lit(len(spec))))
                spec.append([(query, f"{query}.{o}", tag, at) for at, of in enumerate(cells.values()) for o, tag in of])
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).repartition(*ROW)
    slots = [c for c in dealt.columns if c[0] == "s"]
    sums = dealt.groupBy(*ROW, "q", "keys").agg(*[F.sum(c).alias(c) for c in slots])
    structs = [
        F.array(*[F.struct(F.lit(n).alias("query"), F.lit(o).alias("output"), F.lit(tag).alias("tag"), F.lit(at).alias("at")) for n, o, tag, at in family])
        for family in spec
    ]
    return Packed(sums.select(*ROW, "q", "keys", F.array(*slots).alias("s")), F.array(*structs))


def _template(release: Release, term: Term) -> str:
    """A term as text, with marks for the rows of its variables."""
    parts = [str(term.coef)] if term.coef != 1 else []
    for f in term.factors:
        var = f"{f.tag}_{MARKS[release.tables.index(f.table)]}"
        parts.append(var if (f.shift, f.sign) == (0, 1) else f"({f.shift}{'+' if f.sign == 1 else '-'}{var})")
    return "(" + "*".join(parts) + ")"


def packed_texts(tables, names, profile: str = "standard") -> PackedTexts:
    """The terms of several queries as texts, packed: a table row is counted once for all outputs of a release."""
    frames, spec = [], []
    for query in names:
        release = RELEASES[query]
        rows = contributing(tables, query, profile)
        for whole in (False, True):
            cells: dict[tuple, list[tuple[str, str]]] = {}
            for o in release.outputs:
                if ((query, o.name) in GLOBAL_OUTPUTS) == whole:
                    for text, n in Counter(_template(release, term) for term in o.terms).items():
                        cells.setdefault((o.where, o.limited, n), []).append((f"{query}.{o.name}", text))
            if not cells:
                continue
            keys = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in (() if whole else release.keys)])
            counts = []
            for at, (where, limited, n) in enumerate(cells):
                amount = F.lit(n).cast("bigint")
                for condition in [where] * bool(where) + ["reported"] * limited:
                    amount = F.when(F.col(condition), amount)
                counts.append(amount.alias(f"s{at}"))
            parts = [row_part(t) for t in release.tables] + [F.lit("")]
            frame = rows.select(parts[0].alias("row"), parts[1].alias("other"), keys.alias("keys"), *counts)
            frames.append(frame.withColumn("q", F.lit(len(spec))))
            spec.append([(o, text, at) for at, of in enumerate(cells.values()) for o, text in of])
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    slots = [c for c in every.columns if c[0] == "s"]
    counts = every.groupBy("row", "other", "q", "keys").agg(*[F.sum(c).alias(c) for c in slots])
    structs = [
        F.array(*[F.struct(F.lit(o).alias("output"), F.lit(text).alias("text"), F.lit(at).alias("at")) for o, text, at in family]) for family in spec
    ]
    return PackedTexts(counts.select("row", "other", "q", "keys", F.array(*slots).alias("s")), F.array(*structs))
