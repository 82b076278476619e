"""Toxicity scores from a convolutional text classifier.

A word is the sum of two embeddings from a hashed table of fixed size, one of the whole word and
one of its first bytes, which inflected and compound forms share. Filters of width one to three
slide over the words of the whole text; each filter's largest response is kept, and a logistic
layer over those gives the score. Everything is trained together by AdaGrad.

Every labelled row counts. A fifth of them, chosen by hash, is kept for calibration, all others are
trained on in each pass. Rows are turned into word numbers once and dealt by hash of the id into parts of about
``part_rows`` rows, which lie sorted in files. Labels are dealt alike and meet their documents within the part, so
that word numbers are shuffled once. In a pass each part goes on from the common model by itself,
and Spark averages the parameters that parts have changed, each over the parts that changed it; what a part
changed is shuffled packed, by the bits that differ from the common model. Only the
model, whose size is fixed, is broadcast and comes back. The result depends on the rows and on
``part_rows``, not on partitions or machines (but for the order of sums of doubles).

Both labels have the same weight in training. Scores are fitted to the labels of all rows kept for
calibration as they occur, and each language gets the threshold that parts its own rows best; languages
with few rows get the common one. The language serves the verdict ``flagged`` only and is no input of the
score.

Scoring reads every whole text once, without a shuffle.

Edge cases: a null or empty text is scored like one without words, and nothing is learnt from it but the share of
toxic rows. Label rows with null id or label, or without a document, are passed over; without both labels the score
is the share of toxic rows (0 if there is none). Repeated label rows count as often as they occur. Rows without id
are scored. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrace.llm import bitmap
from sumtrace.llm import words as W
from sumtrace.llm.blocks import expand, squeeze
from sumtrace.llm.common import arrow_batches
from sumtrace.session import cut, uncut

PART_ROWS = 8192
FILTER_BITS = 26
RANGE_ROWS = 50_000
BLOCK_ROWS = 1024  # of the table of trained numbers, packed together
BATCH = 16
BUCKETS = 1 << 16
DIMENSIONS = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIX_BYTES = 4
EPOCHS = 8
RATE = 0.08
THRESHOLD = 0.3
LEAST_ROWS = 50
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TAPS = sum(WIDTHS)
_N_FILTERS = len(WIDTHS) * FILTERS
# The trained numbers are one table of DIMENSIONS columns: embeddings, then kernel, offset, weights and bias.
_EMBEDDINGS = 2 * BUCKETS
_SIZES = (DIMENSIONS * _TAPS * FILTERS, _N_FILTERS, _N_FILTERS, 1)
_ROWS = _EMBEDDINGS - -sum(_SIZES) // DIMENSIONS


class Model(NamedTuple):
    embedding: np.ndarray  # 2 * BUCKETS x DIMENSIONS
    kernel: np.ndarray  # DIMENSIONS x (taps * FILTERS)
    offset: np.ndarray  # of each filter
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float
    thresholds: dict[str | None, float]


class Lesson(NamedTuple):
    whole: np.ndarray  # buckets of the words of a text
    begin: np.ndarray  # buckets of their beginnings
    toxic: int
    weight: float


def indexed(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the column: buckets of words, of their beginnings, first word of each text."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()))
    out = []
    for _, data, offsets in W.pieces(pa.RecordBatch.from_arrays([lowered], names=["text"])):
        words = W.split(data, offsets, _GAP)
        mask = np.uint64(BUCKETS - 1)
        whole = (W.hashed(words) & mask).astype(np.int64)
        begin = (W.hashed(words, PREFIX_BYTES) >> np.uint64(20) & mask).astype(np.int64) + BUCKETS
        out.append((whole, begin, words.first))
    return out


def responses(x: np.ndarray, first: np.ndarray, kernel: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Response of every filter at every word; words after the end of a text count as zero."""
    y = (kernel.T @ x.T).reshape(_TAPS, FILTERS, len(x))  # filter by filter, so that sums run along memory
    out = np.empty((len(WIDTHS), FILTERS, len(x)), np.float32)
    tap = 0
    for i, width in enumerate(WIDTHS):
        s = out[i]
        s[:] = y[tap]
        for k in range(1, width):
            moved = y[tap + k, :, k:]
            for j in range(1, k + 1):  # the last k words of a text have no word k further on
                at = first[1:] - j
                at = at[(at >= first[:-1]) & (at < moved.shape[1])]
                moved[:, at] = 0
            s[:, : moved.shape[1]] += moved
        tap += width
    out = out.reshape(_N_FILTERS, len(x))
    out += offset[:, None]
    return out.T


def _logits(model: Model, whole: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    pooled = np.tile(np.maximum(model.offset, 0), (len(first) - 1, 1))
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        s = responses(model.embedding[whole] + model.embedding[begin], first, model.kernel, model.offset)
        pooled[full] = np.maximum(np.maximum.reduceat(s.T, first[full], axis=1), 0).T
    return pooled @ model.weights + model.bias


def score(column: pa.Array, model: Model) -> np.ndarray:
    """Scores from 0 to 1 of the texts of a column."""
    parts = [_logits(model, *p) for p in indexed(column)]
    z = np.concatenate(parts) if parts else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -50, 50)))


def _parts(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Embedding, kernel, offset, weights and bias as views of the table of trained numbers."""
    flat, out, at = values[_EMBEDDINGS:].reshape(-1), [values[:_EMBEDDINGS]], 0
    for size in _SIZES:
        out.append(flat[at : at + size])
        at += size
    out[1] = out[1].reshape(DIMENSIONS, _TAPS * FILTERS)
    return tuple(out)


def _start(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Trained numbers before training, and their sums of squared gradients."""
    rng = np.random.Generator(np.random.PCG64(seed))
    values = np.zeros((_ROWS, DIMENSIONS), np.float32)
    embedding, kernel, _, weights, _ = _parts(values)
    embedding[:] = rng.standard_normal(embedding.shape) * 0.1
    kernel[:] = rng.standard_normal(kernel.shape) / np.sqrt(DIMENSIONS)
    weights[:] = rng.standard_normal(weights.shape) * 0.3
    return values, np.full(values.shape, 1e-3, np.float32)


def _model(values: np.ndarray) -> Model:
    *arrays, bias = _parts(values)
    return Model(*arrays, float(bias[0]), 1.0, 0.0, {None: THRESHOLD})


# to which taps the filters of each width belong
_OF_WIDTH = [(sum(WIDTHS[:i]) + k, i, k) for i, w in enumerate(WIDTHS) for k in range(w)]


def _step(values: np.ndarray, squares: np.ndarray, batch: list[Lesson], rate: float) -> None:
    """One step of AdaGrad, in place; texts without words teach nothing."""
    batch = [t for t in batch if len(t.whole)]
    if not batch:
        return
    embedding, kernel, offset, weights, bias = _parts(values)
    whole, begin = np.concatenate([t.whole for t in batch]), np.concatenate([t.begin for t in batch])
    first = np.cumsum([0] + [len(t.whole) for t in batch])
    x = embedding[whole] + embedding[begin]
    s = responses(x, first, kernel, offset).T
    at = np.array([a + s[:, a:b].argmax(axis=1) for a, b in zip(first[:-1], first[1:])])
    top = s[np.arange(_N_FILTERS), at]
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ weights + bias[0], -50, 50)))
    error = (p - [t.toxic for t in batch]) * [t.weight for t in batch] / len(batch)
    back = error[:, None] * weights * (top > 0)
    gradient = np.zeros((_ROWS - _EMBEDDINGS) * DIMENSIONS, np.float32)
    g_kernel, g_offset, g_weights, g_bias = np.split(gradient[: sum(_SIZES)], np.cumsum(_SIZES)[:-1])
    g_offset[:], g_weights[:], g_bias[:] = back.sum(axis=0), error @ h, error.sum()
    g_kernel = g_kernel.reshape(DIMENSIONS, _TAPS, FILTERS)
    cube = kernel.reshape(DIMENSIONS, _TAPS, FILTERS)
    rows, grads = [], []
    for tap, i, k in _OF_WIDTH:
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        pos = at[:, own] + k
        share = back[:, own] * (pos < first[1:, None])
        pos = np.minimum(pos, len(x) - 1)
        g_kernel[:, tap] = np.einsum("df,dfe->ef", share, x[pos])
        used = share != 0
        g_x = (share[:, :, None] * cube[:, tap].T)[used]
        for ids in (whole, begin):
            rows.append(ids[pos[used]])
            grads.append(g_x)
    tail, seen = values[_EMBEDDINGS:].reshape(-1), squares[_EMBEDDINGS:].reshape(-1)
    seen += gradient * gradient
    tail -= rate * gradient / np.sqrt(seen)
    ids = np.concatenate(rows)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad = np.add.reduceat(np.concatenate(grads)[order], begins, axis=0).astype(np.float32)
        ids = ids[begins]
        squares[ids] += grad * grad
        embedding[ids] -= rate * grad / np.sqrt(squares[ids])


def fit(
    texts: list[str | None],
    labels: list[int],
    languages: list[str | None],
    share: float,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 11,
) -> Model:
    """A model of texts at hand, in this process; every fifth text is kept for calibration.

    ``share``: of label 1 among the rows to be scored.
    """
    values, squares = _start(seed)
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return _constant(share, seed)
    docs = [Lesson(*indexed(pa.array([t or ""], pa.large_string()))[0][:2], int(label), 1.0) for t, label in zip(texts, labels)]
    held = np.arange(len(texts)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    rng = np.random.Generator(np.random.PCG64(seed))
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            _step(values, squares, [docs[d] for d in batch], rate)
    model = _model(values)
    judged = np.flatnonzero(held) if held.any() else train
    z = np.concatenate([_logits(model, docs[d].whole, docs[d].begin, np.array([0, len(docs[d].whole)])) for d in judged])
    weight = np.where(y[judged] == 1, share / y[judged].mean(), (1 - share) / (1 - y[judged].mean()))

    def sums(a: float, b: float) -> list[float]:
        p = _sigmoid(a * z + b)
        e, v = weight * (p - y[judged]), weight * p * (1 - p)
        return [(e * z).sum(), e.sum(), (v * z * z).sum(), (v * z).sum(), v.sum()]

    slope, shift = _calibrated(sums)
    p = _sigmoid(slope * z + shift)
    names = np.array([languages[d] or "" for d in judged])
    thresholds: dict[str | None, float] = {None: _best_threshold(p, y[judged], weight)}
    for name in sorted(set(names) - {""}):
        own = names == name
        if own.sum() >= LEAST_ROWS and 0 < y[judged][own].sum() < own.sum():
            thresholds[name] = _best_threshold(p[own], y[judged][own], weight[own])
    return model._replace(slope=slope, shift=shift, thresholds=thresholds)


def _constant(share: float, seed: int = 11) -> Model:
    """A model that gives every text the score ``share``."""
    model = _model(_start(seed)[0])
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return model._replace(weights=model.weights * 0, bias=0.0, shift=prior)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _calibrated(sums: Callable[[float, float], list[float]]) -> tuple[float, float]:
    """Logistic fit of labels on logits z by Newton's method, with a prior that keeps it finite.

    ``sums`` gives at slope and shift the sums of (p-y)z, p-y, vzz, vz and v, where v is p(1-p).
    """
    a, b = 1.0, 0.0
    for _ in range(50):
        ez, e, vzz, vz, v = sums(a, b)
        g = np.array([ez + 0.1 * (a - 1), e + 0.01 * b])
        hess = np.array([[vzz + 0.1, vz], [vz, v + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Threshold of the highest F1, in the middle of the gap between two scores."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(weight[order] * y[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.r_[p[order][1:] < p[order][:-1], True]
    at = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def _lessons(docs: DataFrame, rows: DataFrame, n_parts: int) -> DataFrame:
    """A lesson for each of ``rows`` (doc_id, toxic) and each document of its id, dealt into parts and sorted by hash.

    Texts are turned into buckets of words where they lie, if the filter over the ids lets them through.
    """
    arrow_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    filter_ = bitmap.build(rows.select(F.xxhash64("doc_id").alias("hash")), FILTER_BITS)
    texts = texts.where("doc_id is not null").where(bitmap.may_hold(texts, filter_, F.xxhash64("doc_id"))).withColumn("drawn", F.xxhash64("doc_id", "text"))

    def of(batches):
        for batch in batches:
            cells = []
            for whole, begin, first in indexed(batch.column(0)):
                both = np.stack([whole, begin - BUCKETS]).astype(np.uint16)
                cells += [squeeze(both[:, a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *batch.columns[1:]], names=["words", *batch.schema.names[1:]])

    words = texts.mapInArrow(of, "words binary, lang string, doc_id long, drawn long")
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(n_parts)).cast("int").alias("part")
    both = words.unionByName(rows.select("doc_id", "toxic"), allowMissingColumns=True)
    both = both.select("*", part).repartition(n_parts, "part")
    own = Window.partitionBy("part", "doc_id")  # within the parts, so that words are not shuffled again, as by a join
    times = [F.array_repeat(F.lit(y), F.count_if(F.col("toxic") == y).over(own).cast("int")) for y in (0, 1)]
    both = both.select("part", "drawn", "lang", "words", F.concat(*times).alias("labels")).where("words is not null")
    both = both.select("*", F.explode("labels").alias("toxic")).withColumn("drawn", F.xxhash64("drawn", "toxic"))
    both = both.select("part", (F.pmod("drawn", F.lit(5)) == 4).alias("held"), "drawn", "lang", "toxic", "words")
    return both.sortWithinPartitions("part", "drawn")


def _buckets(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(expand(cell), np.uint16).reshape(2, -1).astype(np.int64)
    return both[0], both[1] + BUCKETS


def _packed(rows: np.ndarray, own: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, cell) of some rows of a table of floats: places in the block, then the bits that differ from the start.

    Bytes of equal rank lie together, which compresses well: the first ones of a float seldom change.
    """
    for some in np.split(rows, np.flatnonzero(np.diff(rows // BLOCK_ROWS)) + 1):
        if len(some):
            bits = own[some].view(np.uint32) ^ start[some].view(np.uint32)
            planes = bits.T.reshape(-1, 1).view(np.uint8).T
            places = (some % BLOCK_ROWS).astype(np.uint16)
            yield int(some[0] // BLOCK_ROWS), squeeze(places.tobytes() + planes.tobytes())


def _unpacked(block: int, cell: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and whole rows that were packed."""
    data = np.frombuffer(expand(cell), np.uint8)
    n = len(data) // (2 + 4 * start.shape[1])
    rows = data[: 2 * n].view(np.uint16).astype(np.int64) + block * BLOCK_ROWS
    bits = np.ascontiguousarray(data[2 * n :].reshape(4, -1).T).view(np.uint32).reshape(-1, n).T
    return rows, (start[rows].view(np.uint32) ^ bits).view(np.float32)


def _pass(lessons: DataFrame, values: np.ndarray, squares: np.ndarray, weight: tuple[float, float], rate: float) -> None:
    """Every part trains on its rows from the same start; what they changed is averaged, in place."""
    spark = lessons.sparkSession
    sent = spark.sparkContext.broadcast(np.hstack([values, squares]))
    names = [f"{kind}{i}" for kind in "vs" for i in range(DIMENSIONS)]

    def changed(part: int, own: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero((seen != sent.value[:, DIMENSIONS:]).any(axis=1))
        cells = list(_packed(rows, np.hstack([own, seen]), sent.value))
        columns = [pa.array([block for block, _ in cells], pa.int32()), pa.array([part] * len(cells), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in cells], pa.binary())], names=["block", "part", "cell"])

    def of(batches):
        part, batch, own, seen = None, [], None, None
        for cells in batches:
            for number, toxic, words in zip(*[cells.column(c).to_pylist() for c in ("part", "toxic", "words")]):
                if number != part:
                    if part is not None:
                        _step(own, seen, batch, rate)
                        yield changed(part, own, seen)
                    part, batch = number, []
                    own, seen = (np.ascontiguousarray(a) for a in np.hsplit(sent.value, 2))
                batch.append(Lesson(*_buckets(words), toxic, weight[toxic]))
                if len(batch) == BATCH:
                    _step(own, seen, batch, rate)
                    batch = []
        if part is not None:
            _step(own, seen, batch, rate)
            yield changed(part, own, seen)

    def averaged(block: int, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(n)
        means = (total[some] / n[some, None]).astype(np.float32)
        columns = [pa.array((some + block * BLOCK_ROWS).astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in means.T]]
        return pa.RecordBatch.from_arrays(columns, names=["row", *names])

    def mean(batches):
        block, total, n = None, None, None
        for cells in batches:
            for number, cell in zip(cells.column("block").to_pylist(), cells.column("cell").to_pylist()):
                if number != block:
                    if block is not None:
                        yield averaged(block, total, n)
                    block, total, n = number, np.zeros((BLOCK_ROWS, 2 * DIMENSIONS)), np.zeros(BLOCK_ROWS, np.int64)
                rows, changes = _unpacked(block, cell, sent.value)
                total[rows - block * BLOCK_ROWS] += changes
                n[rows - block * BLOCK_ROWS] += 1
        if block is not None:
            yield averaged(block, total, n)

    changes = lessons.select("part", "toxic", "words").mapInArrow(of, "block int, part int, cell binary")
    changes = changes.repartition("block").sortWithinPartitions("block", "part")
    means = changes.mapInArrow(mean, ", ".join(["row int", *[f"{c} float" for c in names]])).toArrow()
    rows = means.column("row").to_numpy()
    for kind, into in (("v", values), ("s", squares)):
        for i in range(DIMENSIONS):
            into[rows, i] = means.column(f"{kind}{i}").to_numpy()
    sent.destroy()


def _judged(lessons: DataFrame, model: Model) -> DataFrame:
    """(lang, toxic, z) of every row, z the logit."""
    sent = lessons.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        for batch in batches:
            z = []
            for cell in batch.column(2).to_pylist():
                whole, begin = _buckets(cell)
                z += _logits(sent.value, whole, begin, np.array([0, len(whole)])).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z, pa.float64())], names=["lang", "toxic", "z"])

    return lessons.select("lang", "toxic", "words").mapInArrow(of, "lang string, toxic int, z double")


def _sums(judged: DataFrame) -> Callable[[float, float], list[float]]:
    z = F.col("z")

    def sums(a: float, b: float) -> list[float]:
        t = F.greatest(F.least(z * a + b, F.lit(50.0)), F.lit(-50.0))
        rows = judged.select("z", "toxic", (1 / (1 + F.exp(-t))).alias("p"))
        e, v = F.col("p") - F.col("toxic"), F.col("p") * (1 - F.col("p"))
        return list(rows.agg(*[F.sum(c) for c in (e * z, e, v * z * z, v * z, v)]).first())

    return sums


def _thresholds(judged: DataFrame, n: int, slope: float, shift: float, range_rows: int = RANGE_ROWS) -> dict[str | None, float]:
    """The threshold of the highest F1 over all rows and over those of each language with enough of them.

    Running counts are taken within ranges of logits, from what the ranges above hold together.
    """
    keyed = judged.select(F.lit(None).cast("string").alias("lang"), "toxic", "z", F.lit(True).alias("common")).unionByName(
        judged.where("lang <> ''").select("lang", "toxic", "z", F.lit(False).alias("common"))
    )
    n_ranges = -(-n // range_rows)
    bounds = judged.approxQuantile("z", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges) if n_ranges > 1 else []
    place = sum(((F.col("z") < b).cast("int") for b in bounds), F.lit(0))
    key = ["common", "lang"]
    kinds = keyed.groupBy(*key, "z").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).withColumn("range", place)
    held = kinds.groupBy(*key, "range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    all_, above = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        *key,
        "range",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")],
        *[F.sum(c).over(all_).alias(f"{c}_all") for c in ("n", "hits")],
    )
    held = held.where(f"common or n_all >= {LEAST_ROWS} and hits_all > 0 and hits_all < n_all")
    same = (F.col("a.common") == F.col("b.common")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))
    running = Window.partitionBy(*key, "range").orderBy(F.desc("z"))
    both = kinds.alias("a").join(held.alias("b"), same & (F.col("a.range") == F.col("b.range")))
    both = both.select("a.*", "n_above", "hits_above", "hits_all")
    flagged, hits = (F.sum(c).over(running) + F.col(f"{c}_above") for c in ("n", "hits"))
    f1 = both.select(*key, "z", (2 * hits / (flagged + F.col("hits_all"))).alias("f1"))
    best = f1.groupBy(*key).agg(F.max(F.struct("f1", "z"))["z"].alias("best"))
    lower = same & (F.col("a.z") < F.col("b.best"))
    found = best.alias("b").join(kinds.alias("a"), lower, "left").groupBy("b.lang", "b.best").agg(F.max("a.z").alias("below")).collect()
    p = [(r["lang"], *[_sigmoid(slope * z + shift) if z is not None else 0.0 for z in (r["best"], r["below"])]) for r in found]
    return {lang: float((at + below) / 2) for lang, at, below in p}


def trained(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    part_rows: int = PART_ROWS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 11,
) -> Model:
    """A model of all rows of ``labels`` (doc_id, toxic) where ``learn`` holds of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("doc_id is not null and toxic in (0, 1)").where(learn)
    lessons = cut(_lessons(docs, rows, max(1, -(-rows.count() // part_rows))))
    n = {(r["held"], r["toxic"]): r["count"] for r in lessons.groupBy("held", "toxic").count().collect()}
    both = [sum(n.get((h, label), 0) for h in (False, True)) for label in (0, 1)]
    if not all(both):
        uncut(lessons)
        return _constant(both[1] / max(1, sum(both)), seed)
    apart = len(n) == 4  # both labels on both sides; else all rows serve for both
    train, kept = (lessons.where("NOT held"), lessons.where("held")) if apart else (lessons, lessons)
    weight = tuple(sum(both) / (2 * x) for x in both)
    values, squares = _start(seed)
    for _ in range(epochs):
        _pass(train, values, squares, weight, rate)
    model = _model(values)
    judged = cut(_judged(kept, model))
    slope, shift = _calibrated(_sums(judged))
    n_kept = sum(x for (h, _), x in n.items() if h or not apart)
    thresholds = _thresholds(judged, n_kept, slope, shift)
    uncut(lessons, judged)
    return model._replace(slope=slope, shift=shift, thresholds=thresholds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, flagged) of every row; ``flagged`` by the threshold of the row's language."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))

    def of(batches):
        for batch in batches:
            p = score(batch.column(1), sent.value)
            limit = sent.value.thresholds
            flagged = [x >= limit.get(name, limit[None]) for x, name in zip(p.tolist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array(flagged, pa.bool_())], names=["doc_id", "score", "flagged"]
            )

    return rows.mapInArrow(of, "doc_id long, score double, flagged boolean")
