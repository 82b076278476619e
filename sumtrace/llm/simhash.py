"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; bit i is set if it is set in more than half of the XXH64 hashes
(seed 42) of the text's 4-word shingles. Two documents are linked when their fingerprints
differ in at most ``distance`` bits.

Links are found by multi-index hashing: a fingerprint is cut into segments, each with a
radius, so that any two linked fingerprints differ by no more than the radius in at least
one segment. Each distinct fingerprint is entered in a table under its segment values, and
looks up every value in the Hamming ball around its own segments. The full distance is
checked within the join, so unverified candidates never become rows.

Exact copies share a fingerprint and count once. Table entries with more than ``crowd``
fingerprints are left out of the lookup; the fingerprints that meet there are linked by the
points half-way: two fingerprints differ in at most ``distance`` bits exactly if some value
differs from each in at most half as many. Every such point links its fingerprints to the
least of them, so a crowd of n costs a multiple of n rows and never n squared.

Edge cases: a null text counts as empty, its fingerprint is zero; a text of fewer than four
words is one shingle; a row without doc_id gets a fingerprint and the component that its
fingerprint belongs to (null if no linked row has an id); rows that repeat a doc_id come out as
often as they go in. An empty table gives an empty result; further columns are not read, unless asked to be kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.llm.common import arrow_batches
from sumtrace.llm.components import least_member
from sumtrace.session import cut, uncut

SHINGLE = 4
SEED = 42
DISTANCE = 4
WIDTHS = (23, 23, 18)
CROWD = 2048
_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at the six separators
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[:n].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):  # bounded memory for very long texts
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _ROWS], ends[at : at + _ROWS])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and the columns ``keep``; fp is the fingerprint as BIGINT."""

    def of(batches):
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *keep]
            )

    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *keep).schema
    return rows.mapInArrow(of, schema)


def radii(distance: int, parts: int) -> list[int]:
    """Radius of each segment (-1: not needed): linked values are within it in one segment at least."""
    whole, rest = divmod(distance, parts)
    return [whole if i <= rest else whole - 1 for i in range(parts)]


def ball(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _literals(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{_signed(v)}L" if _signed(v) != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _around(seg: int, own: Column, masks: list[int]) -> Column:
    return F.transform(_literals(masks), lambda m: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(m).alias("key")))


def _table(fps: DataFrame, widths: tuple[int, ...], distance: int) -> tuple[DataFrame, DataFrame]:
    """Table entries (seg, key, fp) and lookups (seg, key, probe)."""
    entries, lookups, low = [], [], 0
    for seg, (width, radius) in enumerate(zip(widths, radii(distance, len(widths)))):
        if radius >= 0:
            own = _segment(F.col("fp"), low, width)
            entries.append(F.struct(F.lit(seg).alias("seg"), own.alias("key")))
            lookups.append(_around(seg, own, ball(width, radius)))
        low += width
    table = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.seg", "e.key", "fp")
    probes = fps.select(F.col("fp").alias("probe"), F.explode(F.concat(*lookups)).alias("e"))
    return table, probes.select("e.seg", "e.key", "probe")


def links(
    fps: DataFrame, distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS, crowd: int = CROWD, spent: list[DataFrame] | None = None
) -> DataFrame:
    """(a, b), a < b: enough pairs of the distinct values ``fps.fp`` within ``distance`` bits to
    connect all that are. All such pairs, but where more than ``crowd`` values meet in one table
    entry: there each is only linked to the least value around a common half-way point.

    What is written on the way is added to ``spent``, to be deleted once the links are used up.
    """
    if sum(widths) != 64:
        raise ValueError("segments must add up to 64 bits")
    table, probes = _table(fps, widths, distance)
    sizes = table.groupBy("seg", "key").count()
    spent = [] if spent is None else spent
    crowded = cut(sizes.where(F.col("count") > crowd).select("seg", "key"))
    spent.append(crowded)
    if not crowded.isEmpty():
        meeting = probes.join(crowded, ["seg", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct()
        spent.append(cut(meeting))
        extra = _half_way(spent[-1], distance)
        table = table.join(crowded, ["seg", "key"], "left_anti")
    else:
        extra = None
    far = F.expr("bit_count(probe ^ fp)") <= distance
    found = (
        probes.alias("p")
        .join(table.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & (F.col("probe") < F.col("fp")) & far)
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    )
    return (found if extra is None else found.unionByName(extra)).distinct()


def _half_way(fps: DataFrame, distance: int) -> DataFrame:
    """Links through points within half the distance of both ends."""
    # An odd distance needs one side rounded up: both sides get it, and the join checks the ends.
    points = fps.select("fp", F.explode(_literals(ball(64, (distance + 1) // 2))).alias("m")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point")
    )
    if distance % 2:
        raise ValueError("the exact way for crowded entries needs an even distance")
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    linked = points.join(hubs, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return linked.distinct()


def grouped(
    docs: DataFrame, distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS, crowd: int = CROWD, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, columns ``keep``) of every row, and (fp, root, component_id, n_links) of every fingerprint; both written.

    ``root`` is the least fingerprint reachable over links, ``component_id`` the least doc_id, ``n_links`` the
    number of other fingerprints found within the distance (a lower bound where entries are crowded).
    """
    printed = cut(fingerprints(docs, keep=keep))
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    spent: list[DataFrame] = []
    pairs = cut(links(distinct.select("fp"), distance, widths, crowd, spent))
    uncut(*spent)
    member = least_member(pairs)
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    )
    linked = cut(distinct.join(member, "fp").join(degree, "fp"))
    component = linked.groupBy("root").agg(F.min("first_doc").alias("of_links"))
    named = linked.join(component, "root").select("fp", "root", "of_links", "n_links")
    classes = distinct.join(named, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("of_links", "first_doc").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    classes = cut(classes)  # so that joins with it are free to split a fingerprint of very many copies
    uncut(pairs, linked)
    return printed, classes


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per row of ``docs``; see :func:`grouped`."""
    printed, classes = grouped(docs, distance, widths, crowd)
    return printed.join(classes, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_links",
    )
