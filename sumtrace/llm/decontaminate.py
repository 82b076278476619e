"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search. Items are parted by their number of distinct
shingles into classes of doubling size, at most ``2**c`` shingles in class c. For each class a
document is seen as windows of ``1.5 * 2**c`` consecutive shingles, one beginning every
``2**(c-1)``: any passage as long as an item of the class lies whole in one window, whatever
the document's length, and an item contained to 0.8 has a Jaccard similarity of at least
0.25 with that window. Item and window agree in one of ``hashes`` minima with probability
``1 - 0.75**32 > 0.9999``; an agreement makes the document a candidate.

Candidates are verified exactly: share of the item's distinct shingles that occur anywhere in
the document, compared as texts. Every link with ``containment`` of at least ``threshold`` comes out.

A filter of fixed size holds the items' shingles and minima. Windows without any shingle of
an item cannot agree with one and are not hashed. No part of it grows with items or documents.

Words are separated as in :mod:`sumtrace.llm.words`, A-Z lowered, shingles have five words.
An item or a document of one to four words has its whole word sequence as only shingle; one
without words (or a null text) has none and never matches. Ties and repeated rows: each pair of
ids comes out once, with the largest containment. Rows without id are searched like others and
come out with a null id. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import bitmap, words as W
from sumtrace.llm.common import arrow_batches, id_and_text
from sumtrace.session import cut, uncut

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 32
FILTER_BITS = 26  # 8 MB
_CELLS = 1 << 18

_rng = np.random.Generator(np.random.PCG64(5))
_TIMES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


def permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` permutations of 64-bit hashes, one per row."""
    return W.mixed(hashes[None, ...] * _TIMES[:k].reshape(-1, *[1] * hashes.ndim) + _PLUS[:k].reshape(-1, *[1] * hashes.ndim))


def keys(size: int, minima: np.ndarray) -> np.ndarray:
    """One hash per minimum that also says the size class and the permutation (the first axis)."""
    place = np.arange(len(minima), dtype=np.uint64) + np.uint64(1 + 1000 * size)
    return W.mixed(minima ^ W.mixed(place).reshape(-1, *[1] * (minima.ndim - 1)))


def size_class(n: int) -> int:
    """Class of an item with n >= 1 distinct shingles: the least c with n <= 2**c."""
    return (n - 1).bit_length()


def shingled(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each shingle in order: hash, text, first byte, end byte."""
    words = W.split(data, offsets)
    h = W.hashed(words)
    full, at = W.runs(words, h, n)
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    short = np.array([W.whole(h[words.first[t] : words.first[t + 1]]) for t in few], np.uint64)
    first = np.concatenate([at, words.first[few]])
    last = np.concatenate([at + n - 1, words.first[few + 1] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    hashes = np.concatenate([full, short])[order]
    return words, hashes, words.text[first], words.start[first], words.end[last]


def _words_of(data: np.ndarray, a: int, b: int) -> str:
    return b" ".join(data[a:b].tobytes().split()).decode("utf-8", "replace")


def prepared(items: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """(item_id, size, shingles, hashes, minima) of every item that has words."""

    def of(batches):
        for batch in batches:
            for piece, data, offsets in W.pieces(batch):
                _, h, text, a, b = shingled(W.LOWER[data], offsets, shingle)
                ids, rows = piece.column(0).to_pylist(), []
                for t in np.unique(text):
                    own = np.flatnonzero(text == t)
                    u, first = np.unique(h[own], return_index=True)
                    c = size_class(len(u))
                    minima = keys(c, permuted(u, hashes).min(axis=1))
                    grams = [_words_of(W.LOWER[data], a[i], b[i]) for i in own[first]]
                    rows.append((ids[t], c, grams, u.view(np.int64).tolist(), minima.view(np.int64).tolist()))
                columns = list(zip(*rows)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "size", "shingles", "hashes", "minima"]
                )

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "item_id long, size int, shingles array<string>, hashes array<long>, minima array<long>"
    )


def _agreeing(h: np.ndarray, hit: np.ndarray, size: int, k: int, filter_: np.ndarray) -> np.ndarray:
    """Minima of a document's windows of one class that may agree with an item."""
    step = max(1, (1 << size) // 2)
    length = max(1, 3 * step)
    at = np.flatnonzero(hit) // step
    begin = np.unique(np.concatenate([at, at - 1, at - 2]))
    begin = begin[begin >= 0] * step
    found = []
    many = max(1, _CELLS // (length * k))
    for i in range(0, len(begin), many):
        inside = np.minimum(begin[i : i + many, None] + np.arange(length), len(h) - 1)
        minima = keys(size, permuted(h[inside], k).min(axis=2)).ravel()
        found.append(minima[bitmap.holds(filter_, minima)])
    return np.unique(np.concatenate(found))


def scanned(docs: DataFrame, sizes: list[int], filter_: np.ndarray, shingle: int, hashes: int, key: str | None = None) -> DataFrame:
    """(doc_id, row, hits, minima) of the documents that may contain an item.

    ``hits``: every shingle of the document that an item may have; ``minima``: those that may agree.
    ``row`` names the row by its content, as ids can be null or repeated, or by the column ``key``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def of(batches):
        known = sent.value
        for batch in batches:
            for piece, data, offsets in W.pieces(batch):
                data = W.LOWER[data]
                _, h, text, a, b = shingled(data, offsets, shingle)
                hit = bitmap.holds(known, h)
                ids, rows = piece.column(0), []
                for t in np.unique(text[hit]):
                    lo, hi = np.searchsorted(text, [t, t + 1])
                    own = np.flatnonzero(hit[lo:hi])
                    minima = np.concatenate([_agreeing(h[lo:hi], hit[lo:hi], c, hashes, known) for c in sizes])
                    if len(minima):
                        _, first = np.unique(h[lo:hi][own], return_index=True)
                        grams = [_words_of(data, a[lo + i], b[lo + i]) for i in own[first]]
                        doc = ids[int(t)].as_py()
                        row = xxhash.xxh128_hexdigest(f"{doc} ".encode() + data[offsets[t] : offsets[t + 1]].tobytes()) if key is None else piece.column(2)[int(t)].as_py()
                        rows.append((doc, row, grams, np.unique(minima).view(np.int64).tolist()))
                if rows:
                    types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "row", "hits", "minima"]
                    )

    rows = id_and_text(docs) if key is None else docs.select(*id_and_text(docs).columns, key)
    return rows.mapInArrow(of, "doc_id long, row string, hits array<string>, minima array<long>")


def _found(
    docs: DataFrame, items: DataFrame, threshold: float, shingle: int, hashes: int, filter_bits: int, key: str | None
) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, row, item_id, n_shingles, n_found, containment) of all links, and the written frames they are made of."""
    arrow_batches(docs.sparkSession)
    ready = cut(prepared(items, shingle, hashes))
    known = ready.select(F.explode(F.concat("hashes", "minima")).alias("hash"))
    filter_ = bitmap.build(known, filter_bits)
    sizes = sorted(r[0] for r in ready.select("size").distinct().collect())  # at most 32 classes
    seen = cut(scanned(docs, sizes, filter_, shingle, hashes, key))
    candidates = (
        seen.select("row", F.explode("minima").alias("minimum"))
        .join(ready.select("item_id", F.explode("minima").alias("minimum")), "minimum")
        .select("row", "item_id")
        .distinct()
    )
    found = (
        candidates.join(seen.select("doc_id", "row", "hits").dropDuplicates(["row"]), "row")
        .join(
            ready.select("item_id", "shingles", F.size("shingles").cast("long").alias("n_shingles")),
            candidates["item_id"].eqNullSafe(ready["item_id"]),
        )
        .select(
            "doc_id", "row", candidates["item_id"], "n_shingles", F.size(F.array_intersect("hits", "shingles")).cast("long").alias("n_found")
        )
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .where(F.col("containment") >= threshold)
    )
    return found, [ready, seen]


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    hashes: int = HASHES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of all links of at least ``threshold``."""
    found, _ = _found(docs, items, threshold, shingle, hashes, filter_bits, None)
    best = F.max(F.struct("containment", "n_found", "n_shingles")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment")


def rows_with_items(docs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(``key``): the values of this column in rows that contain an item, each once; written."""
    found, spent = _found(docs, items, THRESHOLD, SHINGLE, HASHES, FILTER_BITS, key)
    rows = cut(found.select(F.col("row").alias(key)).distinct())
    uncut(*spent)
    return rows
