"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords, and a linear softmax over that average
gives the languages. Subwords are runs of two to four UTF-8 bytes of the lowered text that lie
in a word or reach over one of its ends; every other character than a letter ends a word.
They are hashed into a table of fixed size. Table and softmax are trained together by
stochastic gradient descent, on whole texts and on short passages of them, so that short texts
are judged soundly too.

The model is fitted on the driver on a bounded sample, about ``per_language`` rows of each
language chosen by hash of the id. A part of it is set aside for calibration: a temperature for
the probabilities, so that a score says how often such an answer is right, and the least score that
is accepted: at most a half, and lower where more than ``max_lost`` of the right answers would go. Model size depends on the number of languages only.

Scoring reads every whole text once, without a shuffle. As averaging and the softmax's weights
are both linear, the table is multiplied by the weights first.

Edge cases: a null text or one without a letter is ``und`` with score 0 and is not accepted. Training
rows with a null language or text are passed over; with no training row at all, every text is ``und``.
With one language every text with a letter gets it. A null id counts as an empty one for the
folds. Further columns are passed through where the caller names them and are otherwise not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches, bounded_sample

UNKNOWN = "und"
PER_LANGUAGE = 500
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.5
MAX_LOST = 0.002
SIZES = (2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[[b for b in range(128) if not chr(b).isalpha()]] = 0


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # (buckets of all sizes + one of zeros) x languages
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each subword size, the bucket that begins at each byte; the last bucket means none."""
    letters = _BYTE[data]
    wide = np.concatenate([letters, np.zeros(max(SIZES), np.uint8)]).astype(np.uint32)
    n, out = len(data), []
    for i, size in enumerate(SIZES):
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code |= wide[k : k + n] << np.uint32(8 * k)
        inner = np.ones(n, bool)
        for k in range(1, size - 1):
            inner &= wide[k : k + n] != 0
        if size == 2:
            inner = code != 0
        for k in range(1, size):  # none reaches into the next text
            cut = offsets[1:] - k
            inner[cut[cut >= offsets[:-1]]] = False
        bucket = ((code * np.uint32(2_654_435_761)) >> np.uint32(17)).astype(np.int64) + i * BUCKETS
        bucket[~inner] = len(SIZES) * BUCKETS
        out.append(bucket)
    return out


def _bag(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return np.concatenate(subwords(data, np.array([0, len(data)])))


def fit(
    texts: list[str],
    languages: list[str],
    dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    max_lost: float = MAX_LOST,
    seed: int = 7,
) -> Model:
    """Train on labelled texts; every fifth text is kept for calibration."""
    names = sorted(set(languages))
    none = len(SIZES) * BUCKETS
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.uniform(-1, 1, (none + 1, dimensions)).astype(np.float32) / dimensions
    table[none] = 0
    weights = np.zeros((dimensions, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    if not names:
        return Model([], np.zeros((none + 1, 0), np.float32), bias, 1.0, 1.0)
    label = np.array([names.index(x) for x in languages])
    bags = []
    for text in texts:
        whole = text.split()
        at = int(rng.integers(0, max(1, len(whole) - 8)))
        bags.append([_counted(_bag(text)), _counted(_bag(" ".join(whole[at : at + int(rng.integers(3, 16))])))])
    held = np.arange(len(texts)) % 5 == 4
    train = np.flatnonzero(~held)
    steps, step = epochs * len(train) * 2, 0
    for _ in range(epochs):
        for t in rng.permutation(np.concatenate([2 * train, 2 * train + 1])):
            step += 1
            bucket, share = bags[t // 2][t % 2]
            if not len(bucket):
                continue
            lr = rate * (1 - step / (steps + 1))
            mean = share @ table[bucket]
            error = _softmax(mean @ weights + bias)
            error[label[t // 2]] -= 1
            back = weights @ error
            weights -= lr * np.outer(mean, error)
            bias -= 0.1 * lr * error
            table[bucket] -= (lr * len(SIZES) * 10) * share[:, None] * back[None, :]
    logits = table @ weights
    of = np.array([b[1] @ logits[b[0]] + bias for i in np.flatnonzero(held) for b in bags[i]]).reshape(-1, len(names))
    truth = np.repeat(label[held], 2)
    if not len(truth):
        return Model(names, logits, bias, 1.0, 0.0)
    heats = np.geomspace(0.02, 20, 60)
    loss = [-np.log(_softmax(of / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    entire = _softmax(of[::2] / heat)  # the whole texts
    right = np.sort(entire.max(axis=1)[entire.argmax(axis=1) == truth[::2]])
    least = min(0.5, float(right[int(max_lost * len(right))])) if len(right) else 0.0
    return Model(names, logits, bias, heat, least)


def _counted(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket, n = np.unique(bag[bag < len(SIZES) * BUCKETS], return_counts=True)
    return bucket, (n / max(1, n.sum())).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _has_letter(text: str | None) -> bool:
    # the pattern also finds numerals such as fractions
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def predict(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    names, scores = [], []
    lowered = pc.utf8_lower(column.cast(pa.large_string()))
    batch = pa.RecordBatch.from_arrays([lowered], names=["text"])
    for piece, data, offsets in W.pieces(batch):
        n = piece.num_rows
        sums, count = np.zeros((n, len(model.languages))), np.zeros(n)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full) and model.languages:
            for bucket in subwords(data, offsets):
                sums[full] += np.add.reduceat(model.table[bucket], offsets[full], axis=0)
                count[full] += np.add.reduceat((bucket < len(model.table) - 1).astype(np.int32), offsets[full])
        letters = [_has_letter(x) for x in piece.column(0).to_pylist()]
        known = np.array(letters, bool) & bool(model.languages)
        if model.languages:
            p = _softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
            best, top = p.argmax(axis=1), p.max(axis=1)
        else:
            best, top = np.zeros(n, int), np.zeros(n)
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        scores.append(np.where(known, top, 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def trained(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, **settings) -> Model:
    """A model from a bounded sample of the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds."""
    rows = docs.select("doc_id", "text", "lang").where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = bounded_sample(rows, "lang", per_language)
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], **settings)


def identified(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (doc_id by default), then lang_pred, score and accepted, for every row.

    Names of carried columns must differ from those three.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    carry = ["doc_id"] if carry is None else carry
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in carry])
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def of(batches):
        for batch in batches:
            names, scores = predict(batch.column(0), sent.value)
            taken = [n != UNKNOWN and s >= sent.value.least for n, s in zip(names, scores)]
            added = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(taken, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *added], names=[*batch.schema.names[1:], "lang_pred", "score", "accepted"]
            )

    return rows.mapInArrow(of, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, unchanged, without a shuffle."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def of(batches):
        for batch in batches:
            names, scores = predict(batch.column(at), sent.value)
            taken = [n != UNKNOWN and s >= sent.value.least for n, s in zip(names, scores)]
            yield batch.filter(pa.array(taken, pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
