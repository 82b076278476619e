"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts: for every run of up to ``order`` bytes that stands before a byte
in the training texts, which bytes follow and how often. A byte's probability comes from the longest
context that the trie has: its count over the context's total, where a share for escape is set aside
that grows with the number of different bytes seen (method C). A byte that the context has not seen
costs the escape and is looked for in the next shorter context, without the bytes that the longer
one has seen (symbol exclusion), and at last among all symbols left alike. Symbols are the 256
bytes and the end of the text, which also pads contexts at its beginning. For every context the
probabilities add up to one.

Counts are summed by Spark over all training texts, and all of them count: nothing is pruned, and
scores mean the same for a table of any size. Shorter contexts' counts are sums over the longer ones'.
Nobody holds the whole trie. It is parted by the last ``SUFFIX`` bytes of a context: a part has all
longer contexts that end in them with all that these escape to, down to order ``SUFFIX``; the orders below,
at most 257**SUFFIX pairs, go to every task. Blocks of documents ask the parts for the probability
of each of their distinct runs once (:mod:`blocks`). Each part answers at most ``SHARE`` blocks in one
task; there are as many copies of it as that takes.

With ``adaptive_length`` the code length is adaptive instead: every text is scored with the counts
of the part before, starting from nothing.

The base score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the lowered words and an end; c, N and V come
from all training texts, and blocks ask for the counts of their words in the same step.

Edge cases: a null text counts as empty: one end, nothing else. Without training texts every symbol
is equally likely and N is 0. Rows with null or repeated ids are scored like others. An empty table gives
an empty result. A very long text is one row of a block and is worked through in pieces.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import blocks as B
from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches
from sumtrace.session import cut

ORDER = 4
SUFFIX = 2
PARTS = 512  # of the trie, at most
SPLIT = 8  # tasks that sum the counts of one part
SHARE = 4096  # blocks that one copy of a part answers
END = 256
SYMBOLS = 257
_BITS = 9
_PIECE = 1 << 19
_GATHER = 1 << 22
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
END_WORD = np.uint64(0x5EED0F7EA7E9D001)
SMOOTH = 0.1


def runs(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every symbol with the ``order`` symbols before it, and where each text's begin."""
    n = len(offsets) - 1
    size = np.diff(offsets) + order + 1
    stream = np.full(int(size.sum()), END, np.uint64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    stream[np.arange(len(data)) + (order + 1) * text + order] = data
    code = np.zeros(max(0, len(stream) - order), np.uint64)
    for k in range(order + 1):
        code |= stream[k : len(stream) - order + k] << np.uint64(_BITS * (order - k))
    begin = np.cumsum(size) - size
    real = np.ones(len(code), bool)
    for k in range(1, order + 1):  # codes that end in the padding of the next text
        at = begin[1:] - k
        real[at[at < len(code)]] = False
    return code[real], np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])


class Table:
    """Values by 64-bit key, for many lookups at once."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _FREE, np.uint64)
        self.values = [np.zeros(1 << self.bits, np.float32) for _ in values]
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == _FREE
            self.keys[slot[left[free]]] = keys[left[free]]  # of those that meet here the last stays
            done = self.keys[slot[left]] == keys[left]
            for own, v in zip(self.values, values):
                own[slot[left[done]]] = v[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, slot, -1)
        left = np.flatnonzero((out < 0) & (found != _FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (found != _FREE)]
        return out


class Level(NamedTuple):
    """One order: pairs hold log count and log of the probability in a context without
    exclusion; contexts hold log escape, and for the next shorter one without what they have
    seen, log of the total and log escape."""

    pairs: Table
    contexts: Table


class Model(NamedTuple):
    levels: list[Level]  # from order 0 up
    rest: float  # log10 of the probability of each symbol that order 0 has not seen


def model_of(counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from (codes, counts) of orders 0 up; bytes after a longer context must also be
    listed after the shorter one."""
    levels: list[Level] = []
    lower: dict[str, np.ndarray] | None = None
    seen = len(counts[0][0])
    with np.errstate(divide="ignore", invalid="ignore"):
        for order, (codes, n) in enumerate(counts):
            at = np.argsort(codes)
            codes, n = codes[at].astype(np.uint64), n[at].astype(np.float64)
            context = codes >> np.uint64(_BITS)
            names, first, of = np.unique(context, return_index=True, return_inverse=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(codes))).astype(np.float64)
            pairs = Table(codes, np.log10(n), np.log10(n) - np.log10(total + kinds)[of])
            if lower is None:
                down, escape = np.zeros(len(names)), np.zeros(len(names))
            else:
                short = np.uint64((1 << _BITS * order) - 1)
                where = np.searchsorted(lower["codes"], codes & short)
                known = np.add.reduceat(lower["n"][where], first) if len(first) else np.zeros(0)
                parent = np.searchsorted(lower["names"], names & np.uint64((1 << _BITS * (order - 1)) - 1))
                fresh = lower["kinds"][parent] - kinds
                left = lower["total"][parent] - known + fresh
                down = np.where(fresh > 0, np.log10(np.maximum(left, 1e-300)), 0.0)
                escape = np.where(fresh > 0, np.log10(np.maximum(fresh, 1e-300)) - down, 0.0)
            contexts = Table(names, np.log10(kinds) - np.log10(total + kinds), down, escape)
            levels.append(Level(pairs, contexts))
            lower = {"codes": codes, "n": n, "names": names, "total": total, "kinds": kinds}
    return Model(levels, -float(np.log10(max(1, SYMBOLS - seen))))


def log_probabilities(codes: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of the last symbol of each code after the others."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    started = np.zeros(len(codes), bool)
    below, escape = np.zeros(len(codes)), np.zeros(len(codes))  # of the context before
    for order in range(len(model.levels) - 1, -1, -1):
        level = model.levels[order]
        code = codes[left] & np.uint64((1 << _BITS * (order + 1)) - 1)
        at = level.pairs.find(code)
        hit = at >= 0
        own, at = left[hit], at[hit]
        out[own] += np.where(started[own], level.pairs.values[0][at] - below[own], level.pairs.values[1][at])
        left, code = left[~hit], code[~hit]
        if not len(left):
            return out
        out[left] += np.where(started[left], escape[left], 0.0)
        at = level.contexts.find(code >> np.uint64(_BITS))
        there = at >= 0
        own, at = left[there], at[there]
        out[own] += np.where(started[own], 0.0, level.contexts.values[0][at])
        below[own], escape[own] = level.contexts.values[1][at], level.contexts.values[2][at]
        started[own] = True
    out[left] += model.rest
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    words = W.split(W.LOWER[data], offsets)
    return words, W.hashed(words)


RUNS, WORDS = 0, 1
_PACKED = "kind int, bucket int, keys binary, counts binary"


def _ending(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes with the last ``order`` symbols of the context only."""
    return codes & np.uint64((1 << _BITS * (order + 1)) - 1)


def _part(codes: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of the trie that knows each run: the same for all contexts that end alike."""
    return (W.mixed(_ending(codes, SUFFIX) >> np.uint64(_BITS)) % np.uint64(n_parts)).astype(np.int64)


def _of_word(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (W.mixed(keys) % np.uint64(n_buckets)).astype(np.int64)


def _by_bucket(kind: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    parts = zip(np.split(keys[order], at[1:]), np.split(counts[order], at[1:]))
    return [(kind, int(i), k.tobytes(), n.tobytes()) for i, (k, n) in zip(ids, parts)]


def counted(docs: DataFrame, order: int, n_buckets: int, n_parts: int = 1) -> DataFrame:
    """Counts over all texts of ``docs``, packed by bucket: kind 0, symbol runs, ``SPLIT`` buckets
    for each part of the trie; kind 1, words."""

    def bucket_of(kind: int, keys: np.ndarray) -> np.ndarray:
        if kind == WORDS:
            return _of_word(keys, n_buckets)
        return _part(keys, n_parts) * SPLIT + (W.mixed(keys) % np.uint64(SPLIT)).astype(np.int64)

    def scan(batches):
        held: list[list] = [[], []]
        size = 0

        def packed():
            rows = []
            for kind, own in enumerate(held):
                if own:
                    k, n = _summed([x[0] for x in own], [x[1] for x in own])
                    rows += _by_bucket(kind, k, n, bucket_of(kind, k))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=["kind", "bucket", "keys", "counts"],
            )

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for piece, data, offsets in W.pieces(batch, size=_PIECE):
                    k, n = np.unique(runs(data, offsets, order)[0], return_counts=True)
                    held[0].append((k, n.astype(np.int64)))
                    _, h = _words(data, offsets)
                    h = np.concatenate([h, np.full(piece.num_rows, END_WORD)])
                    w, m = np.unique(h, return_counts=True)
                    held[1].append((w, m.astype(np.int64)))
                    size += len(k) + len(w)
                    if size > _GATHER:
                        held = [[_summed([x[0] for x in own], [x[1] for x in own])] for own in held]
                        size = sum(len(own[0][0]) for own in held)
                        if size > _GATHER // 2:
                            yield packed()
                            held, size = [[], []], 0
            elif size:
                yield packed()

    def merged(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
        k, n = _summed(keys, counts)
        return pa.table(
            [table.column("kind").slice(0, 1), table.column("bucket").slice(0, 1), pa.array([k.tobytes()]), pa.array([n.tobytes()]), pa.array([len(k)]), pa.array([int(n.sum())])],
            names=["kind", "bucket", "keys", "counts", "distinct", "total"],
        )

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, _PACKED)
    return rows.groupBy("kind", "bucket").applyInArrow(merged, _PACKED + ", distinct long, total long")


def shortest(counts: DataFrame, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of the orders below ``SUFFIX``, from 0 up: at most 257**SUFFIX pairs each."""
    top = min(order, SUFFIX - 1)

    def shortened(batches):
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, n = _summed([_ending(np.frombuffer(k, np.uint64), top)], [np.frombuffer(n, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

    rows = counts.where(F.col("kind") == RUNS).select("keys", "counts").mapInArrow(shortened, "code long, n long")
    table = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return [_summed([_ending(codes, k)], [n]) for k in range(top + 1)]


def part_model(short: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, n: np.ndarray, order: int = ORDER) -> Model:
    """The model of one part: the short orders, and the longer ones of its own runs."""
    return model_of([*short, *(_summed([_ending(codes, k)], [n]) for k in range(len(short), order + 1))])


def adaptive_length(text: str | None, order: int = ORDER) -> float:
    """Code length of one text in bits when the model learns from the text itself as it goes."""
    symbols = [END] * order + [*(text or "").encode(), END]
    trie: dict[tuple[int, ...], dict[int, int]] = {}
    bits = 0.0
    for i in range(order, len(symbols)):
        symbol, excluded, p = symbols[i], set(), 1.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in trie.get(tuple(symbols[i - k : i]), {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                p *= seen[symbol] / total
                break
            p *= len(seen) / total
            excluded |= set(seen)
        else:
            p /= SYMBOLS - len(excluded)
        bits -= float(np.log2(p))
        for k in range(order + 1):
            follows = trie.setdefault(tuple(symbols[i - k : i]), {})
            follows[symbol] = follows.get(symbol, 0) + 1
    return bits


def _squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return B.squeeze(np.diff(keys, prepend=np.uint64(0)).tobytes())


def _expanded(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(B.expand(data), np.uint64), dtype=np.uint64)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _packed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of packed rows, sorted by key."""
    keys = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
    n = [np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()]
    return _summed([np.zeros(0, np.uint64), *keys], [np.zeros(0, np.int64), *n])


def _in_groups(arrays: list[np.ndarray], size: int):
    """Neighbouring arrays, ``size`` values or a little more at a time."""
    held: list[np.ndarray] = []
    for x in arrays:
        held.append(x)
        if sum(map(len, held)) >= size:
            yield held
            held = []
    if held:
        yield held


def scored(docs: DataFrame, learn: Column, order: int = ORDER, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows where ``learn`` holds.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt, n_blocks = B.dealt(rows, "text", block_bytes)
    n_buckets, n_parts, n_copies = n_blocks, min(n_blocks, PARTS), -(-n_blocks // SHARE)
    counts = cut(counted(docs.where(learn), order, n_buckets, n_parts))
    total, distinct = counts.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0
    sent = spark.sparkContext.broadcast(shortest(counts, order))
    scale = float(np.log10(total + SMOOTH * (distinct + 1)))

    def ask(table: pa.Table) -> pa.Table:
        words, codes, size = [np.array([END_WORD])], [], 0
        for batch in table.to_batches():
            for _, data, offsets in W.pieces(batch, size=_PIECE):
                words.append(np.unique(_words(data, offsets)[1]))
                codes.append(np.unique(runs(data, offsets, order)[0]))
                size += len(words[-1]) + len(codes[-1])
                if size > _GATHER:
                    words, codes = [_distinct(words)], [_distinct(codes)]
                    size = 0
        block = table.column(B.BLOCK)[0].as_py()
        keys = _distinct(words)
        asked = [(WORDS, b, 0, k) for _, b, k, _ in _by_bucket(WORDS, keys, keys, _of_word(keys, n_buckets))]
        keys = _distinct(codes)
        asked += [(RUNS, b, block % n_copies, k) for _, b, k, _ in _by_bucket(RUNS, keys, keys, _part(keys, n_parts))]
        kinds, buckets, copies, blobs = zip(*asked)
        return pa.table(
            [
                pa.array([block] * len(asked), pa.int32()),
                pa.array(kinds, pa.int32()),
                pa.array(buckets, pa.int32()),
                pa.array(copies, pa.int32()),
                pa.array([_squeezed(np.frombuffer(k, np.uint64)) for k in blobs], pa.binary()),
            ],
            names=[B.BLOCK, "kind", "bucket", "copy", "keys"],
        )

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        questions = [_expanded(x) for x in asked.column("keys").to_pylist()]
        replies: list[bytes] = []
        if questions:
            keys, n = _packed(known)
            words = asked.column("kind")[0].as_py() == WORDS
            model = None if words else part_model(sent.value, keys, n, order)
            for some in _in_groups(questions, _PIECE):
                own = np.concatenate(some)
                if words:
                    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                    values = np.where(keys[at] == own, n[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                else:
                    values = log_probabilities(own, model).astype(np.float32)
                replies += [B.squeeze(v.tobytes()) for v in np.split(values, np.cumsum([len(x) for x in some])[:-1])]
        return pa.table(
            [asked.column(B.BLOCK), asked.column("kind"), asked.column("keys"), pa.array(replies, pa.binary())],
            names=[B.BLOCK, "kind", "keys", "reply"],
        )

    def replies_to(answers: pa.Table, kind: int, of: type) -> tuple[np.ndarray, np.ndarray]:
        own = answers.filter(pc.equal(answers.column("kind"), kind))
        keys = np.concatenate([_expanded(x) for x in own.column("keys").to_pylist()])
        return keys, np.concatenate([np.frombuffer(B.expand(x), of) for x in own.column("reply").to_pylist()])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, n = replies_to(answers, WORDS, np.int64)
        by_key = np.argsort(keys)
        keys, n = keys[by_key], n[by_key]
        end = n[np.searchsorted(keys, END_WORD)]
        likely = Table(*replies_to(answers, RUNS, np.float32))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for batch in table.to_batches():
            for piece, data, offsets in W.pieces(batch, size=_PIECE):
                words, h = _words(data, offsets)
                c = n[np.searchsorted(keys, h)]
                logs, known = np.log10(c + SMOOTH), (c > 0).astype(np.int64)
                base = np.full(piece.num_rows, np.log10(end + SMOOTH))
                n_known = np.full(piece.num_rows, int(end > 0))
                full = np.flatnonzero(words.count)
                if len(full):
                    base[full] += np.add.reduceat(logs, words.first[:-1][full])
                    n_known[full] += np.add.reduceat(known, words.first[:-1][full])
                codes, begin = runs(data, offsets, order)
                score = np.add.reduceat(likely.values[0][likely.find(codes)].astype(np.float64), begin[:-1])
                n_tokens = words.count + 1
                for own, value in zip(out, (n_tokens, n_known, base - n_tokens * scale, score)):
                    own.append(value)
        values = [np.concatenate(v) for v in out]
        return pa.table(
            [table.column("doc_id"), pa.array(values[0]), pa.array(values[1]), pa.array(np.full(len(values[0]), total)), pa.array(values[2]), pa.array(values[3])],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    questions = dealt.groupBy(B.BLOCK).applyInArrow(ask, f"{B.BLOCK} int, kind int, bucket int, copy int, keys binary")
    whole_words = counts.where(F.col("kind") == WORDS).select("kind", "bucket", F.lit(0).alias("copy"), "keys", "counts")
    parts = counts.where(F.col("kind") == RUNS).select(
        "kind",
        F.expr(f"bucket div {SPLIT}").cast("int").alias("bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(n_copies - 1))).alias("copy"),
        "keys",
        "counts",
    )
    place = ["kind", "bucket", "copy"]
    answers = questions.groupBy(*place).cogroup(whole_words.unionByName(parts).groupBy(*place)).applyInArrow(
        reply, f"{B.BLOCK} int, kind int, keys binary, reply binary"
    )
    return dealt.groupBy(B.BLOCK).cogroup(answers.groupBy(B.BLOCK)).applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
