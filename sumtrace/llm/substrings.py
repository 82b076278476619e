"""Removal of passages that an earlier document has too.

A window is ``n`` consecutive words of one document. A word is removed if a window that covers
it also starts in a document with a smaller doc_id. Windows are judged on the input.

Difference-cover anchors find the windows: an anchor is a run of ``n - period + 1`` words that
begins at a cover position, one whose place in its document, modulo the period, is in the cover. The
cover is such that any two places differ from some two cover places by the same shift; so if two
windows are equal, an anchor of the one and an anchor of the other are equal and lie at the same
place within them, whatever the places of the windows. With period 7 and cover {0, 1, 3}, three of
seven positions are hashed.

Anchors that occur in one document only are told apart first: anchors are sent as short numbers, once
per task, to buckets that return those seen in several documents as a part of a filter of
fixed size. Around the anchors that pass, matches are extended to whole windows, which are then
compared exactly between all documents, by two hashes of 96 bits together (:mod:`blocks`): a block
of documents asks whether a document outside has the window and a smaller id than any of its own.

Edge cases: null and empty texts have no words. A row without doc_id neither loses words nor makes
others lose any. Rows that repeat a doc_id do not count as earlier than each other. Whole copies of
an earlier text of at least ``n`` words lose everything and stay as rows with an empty text. An
empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrace.llm import blocks as B
from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
FILTER_BITS = (20, 28)  # least and most; 2**28 bits are 32 MB
ANCHORS_AT_ONCE = 1 << 21
BUCKET_BYTES = 4 << 20


def checked_cover(period: int, cover: tuple[int, ...], n: int) -> np.ndarray:
    """Marks of cover positions; raises unless every shift is a difference of two of them."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or n < period:
        raise ValueError("not a difference cover of this period, or the window is shorter than it")
    marks = np.zeros(period, bool)
    marks[list(cover)] = True
    return marks


def _power(n: float, least: int = 0) -> int:
    return max(least, int(n).bit_length() if n > 1 else 0)


class _Anchors:
    """Anchors of texts, and the filter of those that several documents share."""

    def __init__(self, n: int, period: int, cover: tuple[int, ...]):
        self.n, self.period, self.marks = n, period, checked_cover(period, cover, n)
        self.length = n - period + 1

    def of(self, words: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, at = W.runs(words, hashes, self.length)
        text = words.text[at]
        placed = self.marks[(at - words.first[text]) % self.period] & (words.count[text] >= self.n)
        return h[placed], at[placed]

    def windows(self, words: W.Words, at: np.ndarray) -> np.ndarray:
        """First words of all windows around the anchors at the given words."""
        start = (at[:, None] - np.arange(self.period)).ravel()
        text = np.repeat(words.text[at], self.period)
        fits = (start >= words.first[text]) & (start + self.n <= words.first[text + 1])
        mark = np.zeros(len(words.start) + 1, bool)
        mark[start[fits]] = True
        return np.flatnonzero(mark)


def shared_anchors(docs: DataFrame, anchors: _Anchors, size: int, bits: tuple[int, int] = FILTER_BITS) -> np.ndarray:
    """Filter of the anchors that occur in more than one row of ``docs``; ``size``: bytes of text.

    Bucket b owns the b-th part of the filter; within it an anchor has a number of 32 bits.
    """
    spark = docs.sparkSession
    wide = min(bits[1], max(bits[0], _power(size)))
    split = min(wide - 3, _power(size / BUCKET_BYTES))  # log2 of the number of buckets
    part = wide - split

    def numbered(batches):
        held, many, row = [], 0, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for piece, data, offsets in W.pieces(batch):
                    words = W.split(data, offsets)
                    h, at = anchors.of(words, W.hashed(words))
                    held.append((h, words.text[at] + row))
                    many, row = many + len(h), row + piece.num_rows
            if many and (batch is None or many >= ANCHORS_AT_ONCE):
                h, doc = (np.concatenate(x) for x in zip(*held))
                held, many = [], 0
                yield _sent(h, doc, split)

    def repeated(table: pa.Table) -> pa.Table:
        of = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("numbers").to_pylist()]))
        twice = of[1:][of[1:] == of[:-1]]
        on = np.zeros(1 << part, np.uint8)
        on[twice >> np.uint32(32 - part)] = 1
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bytes": [np.packbits(on, bitorder="little").tobytes()]})

    found = (
        docs.select("text").mapInArrow(numbered, "bucket int, numbers binary").groupBy("bucket").applyInArrow(repeated, "bucket int, bytes binary")
    )
    arrow_batches(spark)
    out = np.zeros(1 << (wide - 3), np.uint8)
    step = 1 << (part - 3)
    for bucket, data in found.toLocalIterator():
        out[bucket * step : (bucket + 1) * step] = np.frombuffer(data, np.uint8)
    return out


def _sent(h: np.ndarray, doc: np.ndarray, split: int) -> pa.RecordBatch:
    """Numbers of the anchors by bucket: once for an anchor of one document, twice for more."""
    order = np.argsort(h, kind="stable")  # documents stay in order
    h, doc = h[order], doc[order]
    new = np.r_[True, h[1:] != h[:-1]]
    lead = np.flatnonzero(new)
    several = doc[np.r_[lead[1:], len(h)] - 1] != doc[lead]
    h = np.repeat(h[lead], 1 + several)
    bucket = (h >> np.uint64(64 - split)).astype(np.int64) if split else np.zeros(len(h), np.int64)
    ids, at = np.unique(bucket, return_index=True)
    number = (h >> np.uint64(32 - split)).astype(np.uint32)
    cells = [x.tobytes() for x in np.split(number, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(cells, pa.binary())], names=["bucket", "numbers"])


def _passing(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - (int(len(filter_)).bit_length() + 2))).astype(np.int64)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


class _Block:
    """Windows of a block of documents that may be shared: the distinct ones in order, the least id
    of each, and for every occurrence its document, place and window."""

    def __init__(self, table: pa.Table, anchors: _Anchors, filter_: np.ndarray):
        self.pieces, a, b, doc = [], [], [], []
        for batch in table.to_batches():
            for piece, data, offsets in W.pieces(batch):
                words = W.split(data, offsets)
                h = W.hashed(words)
                found, at = anchors.of(words, h)
                start = anchors.windows(words, at[_passing(filter_, found)])
                ids = piece.column(piece.schema.get_field_index("doc_id"))
                known = ~np.asarray(ids.is_null())
                start = start[known[words.text[start]]]
                lanes = [_hash_at(h, start, anchors.n, lane) for lane in (0, 1)]
                a.append(lanes[0])
                b.append((lanes[1] >> np.uint64(32)).astype(np.uint32))
                doc.append(np.asarray(ids.fill_null(0))[words.text[start]])
                self.pieces.append((piece, words.first, start))
        none = np.zeros(0, np.uint64)
        a, b, doc = np.concatenate([none, *a]), np.concatenate([none.astype(np.uint32), *b]), np.concatenate([np.zeros(0, np.int64), *doc])
        order = np.lexsort((doc, b, a))
        sa, sb = a[order], b[order]
        new = np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])][: len(sa)]
        self.window = np.empty(len(a), np.int64)
        self.window[order] = np.cumsum(new) - 1
        lead = order[new]
        self.a, self.b, self.least, self.doc = a[lead], b[lead], doc[lead], doc


def _hash_at(h: np.ndarray, start: np.ndarray, n: int, lane: int) -> np.ndarray:
    factors = W._random_odd(n, 77 + 1000 * lane + n)
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out += h[start + k] * factors[k]
    return W.mixed(out)


def _without_repeats(
    docs: DataFrame, carry: list[str], verbatim: bool, n: int, period: int, cover: tuple[int, ...], block_bytes: int
) -> DataFrame:
    spark = docs.sparkSession
    anchors = _Anchors(n, period, cover)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"__carry_{i}") for i, c in enumerate(carry)]
    )
    dealt, n_blocks = B.dealt(rows, "text", block_bytes)
    sent = spark.sparkContext.broadcast(shared_anchors(rows, anchors, n_blocks * block_bytes))
    split = min(20, _power(n_blocks))

    def ask(table: pa.Table) -> pa.Table:
        own = _Block(table, anchors, sent.value)
        bucket = (own.a >> np.uint64(64 - split)).astype(np.int64) if split else np.zeros(len(own.a), np.int64)
        ids, at = np.unique(bucket, return_index=True)
        cells = [[x.tobytes() for x in np.split(v, at[1:])][: len(ids)] for v in (own.a, own.b, own.least)]
        block = table.column(B.BLOCK)[0].as_py()
        return pa.table(
            [pa.array([block] * len(ids), pa.int32()), pa.array(ids, pa.int32()), *[pa.array(c, pa.binary()) for c in cells]],
            names=[B.BLOCK, "bucket", "a", "b", "least"],
        )

    def reply(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_pylist() for c in ("a", "b", "least")}
        a, b, least = (np.concatenate([np.frombuffer(x, t) for x in cells[c]]) for c, t in (("a", "<u8"), ("b", "<u4"), ("least", "<i8")))
        order = np.lexsort((least, b, a))
        sa, sb = a[order], b[order]
        new = np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]
        first = least[order[new]][np.cumsum(new) - 1]
        earlier = np.empty(len(a), bool)
        earlier[order] = first < least[order]
        ends = np.cumsum([len(x) // 8 for x in cells["a"]])
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, ends[:-1])]
        return pa.table([table.column(B.BLOCK), table.column("bucket"), pa.array(bits, pa.binary())], names=[B.BLOCK, "bucket", "earlier"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, anchors, sent.value)
        bucket = (own.a >> np.uint64(64 - split)).astype(np.int64) if split else np.zeros(len(own.a), np.int64)
        earlier = np.zeros(len(own.a), bool)
        for at, bits in zip(answers.column("bucket").to_pylist(), answers.column("earlier").to_pylist()):
            lo, hi = np.searchsorted(bucket, [at, at + 1])
            earlier[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        gone = earlier[own.window] | (own.doc > own.least[own.window])
        out, seen = [], 0
        for piece, first, start in own.pieces:
            hit = start[gone[seen : seen + len(start)]]
            seen += len(start)
            change = np.zeros(int(first[-1]) + 1, np.int32)
            change[hit] += 1
            change[hit + n] -= 1
            removed = np.cumsum(change[:-1]) > 0
            out.append(_kept(piece, first, removed, verbatim))
        return pa.Table.from_batches(out)

    result = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    for field in rows.schema.fields[2:]:
        result = result.add(field)
    out = B.answered(
        dealt, ask, f"{B.BLOCK} int, bucket int, a binary, b binary, least binary", reply, f"{B.BLOCK} int, bucket int, earlier binary", finish, result
    )
    return out


def _kept(piece: pa.RecordBatch, first: np.ndarray, removed: np.ndarray, verbatim: bool) -> pa.RecordBatch:
    count = np.diff(first)
    full = np.flatnonzero(count)
    lost = np.zeros(len(count), np.int64)
    if len(full):
        lost[full] = np.add.reduceat(removed.astype(np.int64), first[:-1][full])
    column = piece.column(piece.schema.get_field_index("text"))
    texts = []
    for t, text in enumerate(column.to_pylist()):
        if verbatim and not lost[t]:
            texts.append(text)
            continue
        tokens = (text or "").encode().split()
        if lost[t]:
            tokens = itertools.compress(tokens, (~removed[first[t] : first[t + 1]]).tolist())
        texts.append(b" ".join(tokens).decode())
    names = [c for c in piece.schema.names if c not in ("doc_id", "text", B.BLOCK)]
    return pa.RecordBatch.from_arrays(
        [piece.column(piece.schema.get_field_index("doc_id")), pa.array(count, pa.int64()), pa.array(lost), pa.array(texts, pa.string())]
        + [piece.column(piece.schema.get_field_index(c)) for c in names],
        names=["doc_id", "n_words", "n_removed", "kept", *names],
    )


def without_repeats(
    docs: DataFrame, n: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept``: the words left, joined by one space."""
    return _without_repeats(docs, [], False, n, period, cover, block_bytes)


def cleaned(docs: DataFrame, n: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out of ``text``; other columns are kept.

    Texts that lose nothing stay as they are; the words left of others are joined by one space.
    ``n_chars``, if there is such a column, is counted anew for texts that change.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _without_repeats(docs, carry, True, n, period, cover, B.BLOCK_BYTES)
    names = {c: f"__carry_{i}" for i, c in enumerate(carry)}
    columns = []
    for field in docs.schema.fields:
        if field.name == "doc_id":
            value = F.col("doc_id")
        elif field.name == "text":
            value = F.col("kept")
        elif field.name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(names["n_chars"]))
        else:
            value = F.col(names[field.name])
        columns.append(value.cast(field.dataType).alias(field.name))
    return out.select(*columns)
