"""License scan with DataFrame functions only: MinHash bands over overlapping windows.

Words are runs of letters and digits of the lowered text (every other ASCII character parts them),
shingles have five words. Templates are parted by their number of distinct shingles into classes,
at most ``2**c`` in class c. For each class, a text is seen as windows of ``2**c + 2**(c-1) - 1``
consecutive shingles that begin every ``2**(c-1)``: any passage as long as a template of the
class lies whole in one window, and a template contained to 0.8 has a Jaccard similarity of at
least 0.25 with that window. There are as many bands, of one row each, as it takes to make the
probability that such a window shares none with the template less than ``miss``.

A window that shares a band with a template is compared with it exactly, shingle by shingle as
texts. The best window of each document and template with a containment of at least ``threshold``
comes out.

Templates are a parameter, a few texts on the driver (at most ``MOST_SHINGLES`` shingles together).
Their shingles' hashes serve as a first test, as literals in the plan: a window without any of
them cannot match and is not hashed.

Edge cases: null and empty texts have no shingles. A text or template of one to four words has its
whole word sequence as only shingle. Each pair of doc_id and license comes out once, also for
repeated or null ids. An empty table or no template gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrace.session import cut

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-4
MOST_SHINGLES = 5000

#: Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bands_needed(jaccard: float, rows: int, miss: float) -> int:
    """Least number of bands of ``rows`` rows that all fail at this similarity with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - jaccard**rows))


def least_similarity(threshold: float) -> float:
    """Least Jaccard similarity of a window with a template contained to ``threshold``: such a template
    of q shingles, more than half its class's size s, shares t q of the window's 1.5 s."""
    return threshold / 2 / (1.5 + 0.5 - threshold / 2)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _starts(size: Column, n: int) -> Column:
    """Places of shingles among ``size`` words, from 0; none for no words."""
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(own: Column, n: int) -> Column:
    """64-bit hash of each shingle in order; of the whole sequence where there are fewer words."""
    full = F.transform(_starts(F.size(own), n), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(n)]))
    return F.when(F.size(own) >= n, full).when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(own: Column, n: int) -> Column:
    """The distinct shingles as texts."""
    return F.array_distinct(F.transform(_starts(F.size(own), n), lambda i: F.array_join(F.slice(own, i + 1, n), " ")))


def signature(hashes: Column, bands: int) -> Column:
    """Least value of each of ``bands`` hash functions over the shingles."""
    seeds = F.expr("sequence(0, " + str(bands - 1) + ")")
    return _bound(hashes, lambda own: F.transform(seeds, lambda k: F.array_min(F.transform(own, lambda h: F.xxhash64(h, k)))))


def size_class(n: Column) -> Column:
    """Least c with n <= 2**c."""
    return F.ceil(F.log2(n.cast("double"))).cast("int")


def window_shape(size: int) -> tuple[int, int]:
    """Step and length in shingles of the windows of a class."""
    step = max(1, (1 << size) // 2)
    return step, (1 << size) + step - 1


def prepared(spark: SparkSession, templates: dict[str, str], shingle: int, bands: int) -> DataFrame:
    """(license, size, shingles, hashes, minima) of every template that has words."""
    given = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in sorted(templates.items())]
    rows = spark.range(1).select(F.explode(F.array(*given)).alias("t")).select("t.license", words(F.col("t.text")).alias("w"))
    rows = rows.where(F.size("w") > 0).select("license", shingle_texts(F.col("w"), shingle).alias("shingles"), F.array_distinct(shingle_hashes(F.col("w"), shingle)).alias("hashes"))
    return rows.select("license", size_class(F.size("shingles")).alias("size"), "shingles", "hashes", signature(F.col("hashes"), bands).alias("minima"))


def _windows(found: DataFrame, size: int, known: list[int], shingle: int, bands: int) -> DataFrame:
    step, length = window_shape(size)
    every = F.sequence(F.lit(0), (F.size("h") - 1) - F.pmod(F.size("h") - 1, F.lit(step)), F.lit(step))
    # the arrays of the whole text stay in one row: only windows are exploded
    near = F.filter(every, lambda i: F.exists(F.slice("h", i + 1, length), lambda x: x.isin(known)))
    cut_out = F.transform(
        near,
        lambda i: F.struct(
            F.lit(size).alias("size"),
            i.alias("first_word"),
            signature(F.array_distinct(F.slice("h", i + 1, length)), bands).alias("minima"),
            F.slice("w", i + 1, length + shingle - 1).alias("w"),
        ),
    )
    return found.select("doc_id", "row", F.explode(cut_out).alias("x")).select("doc_id", "row", "x.size", "x.first_word", "x.minima", "x.w")


def licensed(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment, first_word) of the best window of each match.

    ``first_word``: place of the window's first word in the text, from 0.
    """
    spark = docs.sparkSession
    bands = bands_needed(least_similarity(threshold), 1, miss)
    empty = "doc_id long, license string, n_shingles long, n_found long, containment double, first_word long"
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return spark.createDataFrame([], empty)
    ready = prepared(spark, templates, shingle, bands)
    rows = ready.select("size", "hashes").collect()
    known = sorted({h for r in rows for h in r["hashes"]})
    if len(known) > MOST_SHINGLES:
        raise ValueError(f"{len(known)} template shingles; at most {MOST_SHINGLES} go into a plan")
    if not known:
        return spark.createDataFrame([], empty)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row"),
        _bound(words(F.col("text")), lambda w: F.struct(w.alias("w"), shingle_hashes(w, shingle).alias("h"))).alias("s"),
    )
    found = cut(hashed.where(F.exists("s.h", lambda x: x.isin(known))).select("doc_id", "row", "s.w", "s.h"))
    windows = cut(reduce(DataFrame.unionByName, [_windows(found, s, known, shingle, bands) for s in sorted({r["size"] for r in rows})]))
    keyed = windows.select("row", "size", "first_word", F.posexplode("minima").alias("band", "minimum"))
    keys = ready.select("license", "size", F.posexplode("minima").alias("band", "minimum"))
    candidates = keyed.join(keys, ["size", "band", "minimum"]).select("row", "size", "first_word", "license").distinct()
    compared = (
        candidates.join(windows.select("doc_id", "row", "size", "first_word", "w"), ["row", "size", "first_word"])
        .join(ready.select("license", "shingles"), "license")
        .select(
            "doc_id",
            "license",
            F.size("shingles").cast("long").alias("n_shingles"),
            F.size(F.array_intersect("shingles", shingle_texts(F.col("w"), shingle))).cast("long").alias("n_found"),
            F.col("first_word").cast("long").alias("first_word"),
        )
        .where(F.col("n_found") >= threshold * F.col("n_shingles"))
    )
    best = F.max(F.struct("n_found", (-F.col("first_word")).alias("before"), "n_shingles")).alias("b")
    return (
        compared.groupBy("doc_id", "license")
        .agg(best)
        .select("doc_id", "license", "b.n_shingles", "b.n_found", (F.col("b.n_found") / F.col("b.n_shingles")).alias("containment"), (-F.col("b.before")).alias("first_word"))
    )
