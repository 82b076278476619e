"""Fingerprints of documents from their improbable features, for telling how alike two texts are.

A feature is a window of ``WIDTH`` bytes. Its entropy, in thousandths of the greatest, is a class; a class
is the rarer the fewer windows of the whole corpus fall into it (:func:`rarity`, counted by Spark over
all texts). Among any ``RUN`` windows in a row the leftmost one of the rarest class gets a point; windows with
``POINTS`` or more are selected. Which windows are selected depends on their surroundings of a
few dozen bytes only, so texts that share a passage share the features within it.

The different selected features are hashed into chained Bloom filters in the order in which they
occur: ``FEATURES`` fill a filter, then the next one begins. A fingerprint is as long as its text
needs. As text: for each filter two hexadecimal digits for the number of features and the bits.

Two filters are compared by the bits they have in common, normalised: what chance gives to so many
features counts as 0, as many as the emptier filter has as 1, and up to three standard deviations
above chance as 0. A fingerprint's likeness to another is the mean over the filters of the one with
fewer features, by their features, of the best match among the other's.

Neighbours are found without collecting anything: rows are sorted by range of descending doc_id, each
task pairs its rows in a stream, and the two rows at the borders of a range meet in a join. The last key of the
range is a number of the row, so that equal rows may lie in several ranges.

Edge cases: a null text counts as empty; an empty text has the empty fingerprint, like itself (1) and
unlike any other (0). A text shorter than a window, or of windows nearly without entropy only, has one
feature: itself. Rows without doc_id come last; rows of one id are in the order of a hash of their
texts. In a table of one row this is its own next one. Very long texts are worked through in pieces. An empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import blocks as B
from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches, id_and_text
from sumtrace.session import cut, uncut

WIDTH = 32
RUN = 32
POINTS = 8
CLASSES = 1001
WEAK = 100
FILTER_BITS = 2048
HASHES = 5
FEATURES = 160
SIGMAS = 3.0
_PIECE = 1 << 18
_TEXTS = 1 << 19
_UNIT = 1024
_FAR = np.int64(1) << 62

_count = np.arange(WIDTH + 1)
_PART = np.round(_count * np.log2(np.maximum(_count, 1)) * _UNIT).astype(np.int32)
_ENTER = np.zeros(WIDTH + 1, np.int32)  # what a byte adds that occurs so often now
_ENTER[1:] = np.diff(_PART)
_FACTOR = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, WIDTH // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def classes(data: np.ndarray) -> np.ndarray:
    """Entropy class of each window of ``WIDTH`` bytes, from its first byte on.

    The sum of c log c over a window's byte counts c is carried from window to window: a byte that
    enters or leaves changes it by what its own count says, and counts come from comparing the
    bytes with themselves shifted by up to a window.
    """
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)  # the byte itself in the window that ends or begins with it
    for k in range(1, WIDTH):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    change = _ENTER[before]
    change[WIDTH:] -= _ENTER[after[: n - WIDTH]]
    total = np.cumsum(change, dtype=np.int64)[WIDTH - 1 :]
    whole = int(_PART[WIDTH])
    return (whole - total) * (CLASSES - 1) // whole


def _inside(offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which windows that begin in [lo, hi) lie within one text."""
    starts = np.arange(lo, hi)
    return offsets[np.searchsorted(offsets, starts, "right")] - starts >= WIDTH


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy class over all windows of all texts: 0 is the rarest."""

    def counted(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for _, data, offsets in W.pieces(batch):
                for lo in range(0, max(0, len(data) - WIDTH + 1), _PIECE):
                    own = classes(data[lo : lo + _PIECE + WIDTH - 1])
                    total += np.bincount(own[_inside(offsets, lo, lo + len(own))], minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["class", "n"])

    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "class long, n long")
    found = rows.groupBy("class").agg(F.sum("n").alias("n")).collect()  # one row per class at most
    n = np.zeros(CLASSES, np.int64)
    for c, k in found:
        n[c] = k
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), n))] = np.arange(CLASSES)
    return ranks


def selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """First bytes of the selected windows of all texts, in order."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(data), _PIECE):
        a = max(0, lo - RUN + 1)
        piece = data[a : lo + _PIECE + RUN + WIDTH - 2]
        own = classes(piece)
        if not len(own):
            break
        usable = _inside(offsets, a, a + len(own)) & (own >= WEAK)
        place = np.arange(len(own))
        key = np.full(len(own) + 2 * (RUN - 1), _FAR)
        key[RUN - 1 : RUN - 1 + len(own)] = np.where(usable, ranks[own] << 32 | place, _FAR)
        least, reach = key, 1
        while reach < RUN:  # least key of ever longer runs
            step = min(reach, RUN - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        best = least[least != _FAR] & 0xFFFFFFFF
        points = np.bincount(best, minlength=len(own))
        at = np.flatnonzero(points >= POINTS) + a
        out.append(at[(at >= lo) & (at < lo + _PIECE)])
    return np.concatenate(out)


def _hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    windows = data[at[:, None] + np.arange(WIDTH)].view(np.uint64)
    return W.mixed(W.mixed(windows * _FACTOR).sum(axis=1, dtype=np.uint64))


def _text_hash(text: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64)


class Print:
    """A fingerprint: features per filter, and the filters' bits as 64-bit words."""

    def __init__(self, counts: np.ndarray, bits: np.ndarray):
        self.counts, self.bits = counts, bits
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        return "".join(f"{n:02x}{row.tobytes().hex()}" for n, row in zip(self.counts.tolist(), self.bits))

    @classmethod
    def parsed(cls, text: str) -> Print:
        size = 2 + FILTER_BITS // 4
        cells = [text[i : i + size] for i in range(0, len(text), size)]
        bits = np.frombuffer(bytes.fromhex("".join(c[2:] for c in cells)), np.uint64)
        return cls(np.array([int(c[:2], 16) for c in cells], np.int64), bits.reshape(len(cells), FILTER_BITS // 64))

    @classmethod
    def of_hashes(cls, hashes: np.ndarray) -> Print:
        """Hashes of features in order; repeated ones count once."""
        _, first = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(first)]
        n = -(-len(hashes) // FEATURES)
        bits = np.zeros((n, FILTER_BITS), bool)
        row = np.arange(len(hashes)) // FEATURES
        width = np.uint64((FILTER_BITS - 1).bit_length())
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(k) * width & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        return cls(np.bincount(row, minlength=n), np.packbits(bits, axis=1).view(np.uint64).reshape(n, FILTER_BITS // 64))


def prints(texts: list[bytes], ranks: np.ndarray) -> list[Print]:
    """Fingerprints of several texts."""
    size = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = selected(data, offsets, ranks)
    hashes = np.concatenate([np.zeros(0, np.uint64), *[_hashed(data, at[i : i + _PIECE // 8]) for i in range(0, len(at), _PIECE // 8)]])
    border = np.searchsorted(at, offsets)
    out = []
    for i, text in enumerate(texts):
        own = hashes[border[i] : border[i + 1]]
        out.append(Print.of_hashes(own if len(own) or not text else _text_hash(text)))
    return out


def likeness(a: Print, b: Print) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a.counts.sum() > b.counts.sum() or (a.counts.sum() == b.counts.sum() and str(a) > str(b)):
        a, b = b, a
    if not len(b.counts):
        return 1.0
    if not len(a.counts):
        return 0.0
    keep = (1 - 1 / FILTER_BITS) ** HASHES
    empty = keep ** b.counts
    best = np.zeros(len(a.counts))
    for i in range(len(a.counts)):
        most = np.minimum(a.ones[i], b.ones)
        chance = FILTER_BITS * (1 - keep ** a.counts[i]) * (1 - empty)
        chance = np.minimum(chance, most)
        common = np.bitwise_count(a.bits[i] & b.bits).sum(axis=1, dtype=np.int64)
        noise = SIGMAS * np.sqrt(chance * (1 - chance / most))
        share = np.where(common - chance > noise, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        best[i] = share.max()
    return float(min(1.0, (best * a.counts).sum() / a.counts.sum()))


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(ids: list, texts: list[str], first: Print | None, ranks: np.ndarray) -> tuple[list[tuple], Print]:
    """Result rows of all but the last text, each beside the next one, and the last one's fingerprint."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    fresh = texts if first is None else texts[1:]
    made = prints([t.encode() for t in [*fresh, *changed]], ranks)
    own = made[: len(fresh)] if first is None else [first, *made[: len(fresh)]]
    rows = []
    for i, (text, after) in enumerate(zip(changed, made[len(fresh) :])):
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((ids[i], len(texts[i]), digest, str(own[i]), str(after), likeness(own[i], after), likeness(own[i], own[i + 1])))
    return rows, own[-1]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x).decode() for x in batch.column(column).to_pylist()]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of some rows at a time, decompressed in bounded amounts."""
    press, ids, texts, size = zstandard.ZstdDecompressor(), [], [], 0
    for i, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(i)
        texts.append(press.decompress(cell).decode())
        size += len(texts[-1])
        if size > _TEXTS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def fingerprinted(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``ranks``: rarity of the entropy classes, of the corpus itself by default. Fingerprints can
    be compared between corpora if the same ranks are given.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ranks = rarity(docs) if ranks is None else ranks
    rows = id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order: list[Column] = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]
    dealt = B.squeezed(rows).repartitionByRange(*order).sortWithinPartitions(*order)

    def of(batches):
        ids, texts, known, opened, part = [], [], None, False, None
        names, types = [*_NAMES, "part", "edge", "cell"], [*_TYPES, pa.int32(), pa.int32(), pa.binary()]
        blank, press = (None,) * (len(_NAMES) - 1), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for own_ids, own_texts in _pieces(batch):
                if not opened:
                    opened, part = True, batch.column(2)[0].as_py()
                    yield _batch([(own_ids[0], *blank, part, 1, press.compress(own_texts[0].encode()))], names, types)
                ids, texts = [*ids[-1:], *own_ids], [*texts[-1:], *own_texts]
                made, known = _compared(ids, texts, known, ranks)
                yield _batch([(*r, part, 0, None) for r in made], names, types)
        if opened:
            yield _batch([(ids[-1], *blank, part, 2, press.compress(texts[-1].encode()))], names, types)

    made = cut(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(of, f"{_RESULT}, part int, edge int, cell binary"))
    parts = sorted(r[0] for r in made.where("edge = 1").select("part").collect())  # one per range
    if not parts:
        return made.select(*_NAMES)
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, following int")
    last = made.where("edge = 2").select("part", "doc_id", "cell").join(following, "part")
    first = made.where("edge = 1").select(F.col("part").alias("following"), F.col("cell").alias("after"))

    def meet(batches):
        for batch in batches:
            rows = []
            for i, a, b in zip(batch.column(0).to_pylist(), _texts(batch, 1), _texts(batch, 2)):
                rows += _compared([i, None], [a, b], None, ranks)[0]
            yield _batch(rows, _NAMES, _TYPES)

    borders = cut(last.join(first, "following").select("doc_id", "cell", "after").mapInArrow(meet, _RESULT))
    whole = cut(made.where("edge = 0").select(*_NAMES).unionByName(borders))
    uncut(made, borders)
    return whole
