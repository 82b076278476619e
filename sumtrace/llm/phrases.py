"""Phrases whose words go together, counted in suffix trees that are built in parts (vertical partitioning).

The tree of all suffixes of all pieces of text, cut off at a depth of ``DEPTH`` words, says how often every
phrase occurs: the total of the leaves below its node. The tree is never built whole. Suffixes
are parted by the words they begin with, their prefix, into groups that fit a budget of ``BUDGET``
suffixes; each group's subtrees are built by themselves, by sorting, and counts are read from leaf
totals. Prefixes have variable length:

* words are counted first. Words that occur less than ``LEAST`` times are in no phrase that counts, so
  suffixes end before them: what is left of the tree is the part that matters, and no count is lost.
  Words with at most ``BUDGET`` suffixes are prefixes and packed into groups by their counts;
* a word with more is extended by its next word, such a pair by a third, and so on. Only pairs of two such
  words can again have too many, so only they are counted. Prefixes that fit are dealt into as
  many groups as their suffixes need.

Texts are dealt into blocks (:mod:`blocks`). A block asks for each of its different words once; what answers
counts the word over all blocks, and gives frequent ones a number and a group. A block then sends each group
its different suffixes with their numbers of occurrences, so a passage that a third of all rows hold is one
row per block. Words are compared as texts, suffixes as numbers of words, so all counts are exact.

Scores, nesting and ranks are joins and aggregations over the nodes that remain. Products of counts
are decimals.

Edge cases: a null text counts as empty, a null lang as ``und``. Repeated rows count as often as they are there.
Ties are broken as the order says, down to the phrase's bytes. A text of any length belongs to one block and
is worked through piece by piece. doc_id is not read, nor are further columns. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import blocks as B
from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches
from sumtrace.session import cut, uncut

DEPTH = 4
LEAST = 30
MOST = 2000
BUDGET = 1 << 20
SCALE = 2_000_000
NESTED = (80, 100)
SALTS = 64
_SEGMENT = 4 << 20

_PARTS = np.zeros(256, bool)
_PARTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _PARTS.copy()
_GAPS[list(b" \t")] = True


def _segments(text: bytes) -> Iterator[np.ndarray]:
    """A text in amounts that end at a separator of pieces."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = at + _SEGMENT
        while end < len(data):
            cuts = np.flatnonzero(_PARTS[data[end : end + _SEGMENT]])
            if len(cuts):
                end += int(cuts[0]) + 1
                break
            end += _SEGMENT
        yield data[at:end]
        at = end


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _cells(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of a binary array."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], np.diff(at)


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different words in the order of their bytes, and the index of each word."""
    table = words.dictionary_encode()
    order = pc.sort_indices(table.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return table.dictionary.take(pa.array(order)), rank[table.indices.to_numpy()]


def tokens(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of a text with A-Z lowered, the index of each word, and whether it begins a piece."""
    words, sizes, begins = [], [], []
    for data in _segments(text.lower()):
        gap = _GAPS[data]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        piece = np.cumsum(_PARTS[data])[start]
        words.append(data[~gap])
        sizes.append(end - start)
        begins.append(np.diff(piece, prepend=-1) > 0)
    if not words:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    for own in begins:
        own[:1] = True
    different, index = _coded(_binary(np.concatenate(words), np.concatenate(sizes)))
    return different, index, np.concatenate(begins)


def _bucket(words: pa.Array, lang: str, n: int) -> np.ndarray:
    data, size = _cells(words)
    end = np.cumsum(size)
    named = W.Words(data, end - size, end, end, end)
    filled = size > 0
    h = np.zeros(len(size), np.uint64)
    if filled.any():
        h[filled] = W.hashed(W.Words(data, named.start[filled], named.end[filled], end, end))
    seed = W.hashed(W.Words(np.frombuffer(lang.encode() + b"\0", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]), end, end))
    return (W.mixed(h ^ seed) % np.uint64(n)).astype(np.int64)


def _packed(array: np.ndarray) -> bytes:
    return B.squeeze(np.ascontiguousarray(array).tobytes())


def _array(cell: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(B.expand(cell), kind)


def _by_lang(table: pa.Table) -> Iterator[tuple[str, bytes]]:
    """Each language of a block, in order, with its texts one after the other."""
    langs = np.array(table.column("lang").to_pylist(), object)
    cells = table.column("text").to_pylist()
    for lang in sorted(set(langs)):
        yield lang, b"\n".join(sorted(B.expand(cells[i]) for i in np.flatnonzero(langs == lang)))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_ASKED = [B.BLOCK, "bucket", "lang", "lengths", "words", "counts"]
_ASKED_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
_TOLD = [B.BLOCK, "bucket", "lang", "lengths", "words", "counts", "ids", "groups"]
_TOLD_TYPES = [*_ASKED_TYPES, pa.binary(), pa.binary()]
_CODED = [B.BLOCK, "lang", "lengths", "words", "counts", "ids", "groups", "sequence"]
_CODED_TYPES = [pa.int32(), pa.string(), *[pa.binary()] * 6]


def _schema(names: list[str], types: list[pa.DataType]) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in zip(names, types))


def encoded(docs: DataFrame, least: int, budget: int, block_bytes: int) -> DataFrame:
    """Blocks as sequences of word numbers (``sequence`` set), and the vocabulary (``words`` set), packed.

    A number stands for a word of one language. In a sequence, which holds indices into ``ids``, 0 parts
    pieces and stands for rare words. A vocabulary's first word may be the empty one: its count is the
    number of all words of the language. ``groups`` is -1 for words with more than ``budget`` occurrences.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    dealt, n_blocks = B.dealt(rows, "text", block_bytes)

    def ask(table: pa.Table) -> pa.Table:
        block, out = table.column(B.BLOCK)[0].as_py(), []
        for lang, text in _by_lang(table):
            different, index, _ = tokens(text)
            if not len(index):
                continue
            counts = np.concatenate([[len(index)], np.bincount(index, minlength=len(different))])
            different = pa.concat_arrays([pa.array([b""], pa.large_binary()), different])
            bucket = _bucket(different, lang, n_blocks)
            for i in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == i)
                data, size = _cells(different.take(pa.array(own)))
                out.append((block, i, lang, _packed(size.astype(np.uint32)), _packed(data), _packed(counts[own])))
        return _table(out, _ASKED, _ASKED_TYPES)

    def reply(table: pa.Table) -> pa.Table:
        bucket, out, number, load = table.column("bucket")[0].as_py(), [], 0, 0
        langs = np.array(table.column("lang").to_pylist(), object)
        columns = {c: table.column(c).to_pylist() for c in (B.BLOCK, "lengths", "words", "counts")}
        for lang in sorted(set(langs)):
            at = np.flatnonzero(langs == lang)
            sizes = [_array(columns["lengths"][i], np.uint32) for i in at]
            data = np.concatenate([_array(columns["words"][i], np.uint8) for i in at])
            counts = np.concatenate([_array(columns["counts"][i], np.int64) for i in at])
            different, index = _coded(_binary(data, np.concatenate(sizes)))
            order = np.argsort(index, kind="stable")
            total = np.add.reduceat(counts[order], np.searchsorted(index[order], np.arange(len(different))))
            frequent = total >= least
            empty = _cells(different[:1])[1][0] == 0
            if empty:
                frequent[0] = False  # the number of all words is no word
            ids = np.zeros(len(total), np.int64)
            ids[frequent] = (bucket << 32) + number + 1 + np.arange(frequent.sum())
            number += int(frequent.sum())
            light = frequent & (total <= budget)
            loads = np.cumsum(total[light])
            groups = np.full(len(total), -1, np.int64)
            groups[light] = (bucket << 20) + (load + loads - total[light]) // budget
            load += int(loads[-1]) if len(loads) else 0
            index = np.split(index, np.cumsum([len(s) for s in sizes])[:-1])
            for i, own in zip(at, index):
                out.append((columns[B.BLOCK][i], bucket, lang, None, None, None, _packed(ids[own]), _packed(groups[own])))
            kept = frequent.copy()
            kept[0] |= empty
            data, size = _cells(different.filter(pa.array(kept)))
            out.append((-1 - bucket, bucket, lang, _packed(size.astype(np.uint32)), _packed(data), _packed(total[kept]), _packed(ids[kept]), _packed(groups[kept])))
        return _table(out, _TOLD, _TOLD_TYPES)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return answers.select(_CODED[:-1]).append_column("sequence", pa.nulls(answers.num_rows, pa.binary()))
        known = {(a, b): (i, g) for a, b, i, g in zip(*[answers.column(c).to_pylist() for c in ("lang", "bucket", "ids", "groups")])}
        all_ids, all_groups, sequence = [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)], [np.zeros(0, np.int64)]
        before = 1
        for lang, text in _by_lang(table):
            different, index, begins = tokens(text)
            if not len(index):
                continue
            bucket = _bucket(pa.concat_arrays([pa.array([b""], pa.large_binary()), different]), lang, n_blocks)
            ids, groups = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
            for i in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == i)
                cells = known[lang, i]
                ids[own], groups[own] = _array(cells[0], np.int64), _array(cells[1], np.int64)
            ids, groups = ids[1:], groups[1:]
            frequent = np.flatnonzero(ids)
            place = np.zeros(len(ids), np.int64)
            place[frequent] = before + np.arange(len(frequent))
            before += len(frequent)
            all_ids.append(ids[frequent])
            all_groups.append(groups[frequent])
            own = np.zeros(len(index) + int(begins.sum()), np.int64)
            own[np.arange(len(index)) + np.cumsum(begins)] = place[index]
            sequence.append(own)
        cells = [_packed(np.concatenate(all_ids)), _packed(np.concatenate(all_groups)), _packed(np.concatenate(sequence).astype(np.int32))]
        return _table([(table.column(B.BLOCK)[0].as_py(), None, None, None, None, *cells)], _CODED, _CODED_TYPES)

    return B.answered(
        B.squeezed(dealt), ask, _schema(_ASKED, _ASKED_TYPES), reply, _schema(_TOLD, _TOLD_TYPES), finish, _schema(_CODED, _CODED_TYPES)
    )


def _windows(sequence: np.ndarray) -> np.ndarray:
    """Every suffix of two words or more, cut off at ``DEPTH``, as a row of indices; 0 behind its end."""
    padded = np.concatenate([sequence, np.zeros(DEPTH, np.int32)])
    rows = np.stack([padded[k : k + len(sequence)] for k in range(DEPTH)], axis=1)
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)]
    for k in range(2, DEPTH):
        rows[rows[:, k - 1] == 0, k] = 0
    return rows


def _different(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of indices below ``n``, in order, and how often each occurs."""
    code = np.zeros(len(rows), np.int64)
    for k in range(rows.shape[1]):  # renumbered after each column, so that codes stay small
        code = np.unique(code * n + rows[:, k], return_inverse=True)[1]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return rows[first], counts


def _prefixes(coded: DataFrame, heavy: DataFrame | None, k: int) -> DataFrame:
    """(block, w1..wk, n): prefixes of ``k`` words that may have too many suffixes, as every part of them has."""
    names = [B.BLOCK, *[f"w{i + 1}" for i in range(k)], "n"]

    def of(batches):
        for batch in batches:
            for block, ids, groups, sequence, known in zip(*[c.to_pylist() for c in batch.columns]):
                ids = _array(ids, np.int64)
                big = (_array(groups, np.int64) < 0) & (ids > 0)
                rows = _windows(_array(sequence, np.int32))[:, :k]
                rows = rows[big[rows].all(axis=1)]
                if k > 2:
                    rows = rows[_is_heavy(ids, rows[:, :-1], known, k - 1) & _is_heavy(ids, rows[:, 1:], known, k - 1)]
                rows, n = _different(rows, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, np.int32)), *[pa.array(ids[rows[:, i]]) for i in range(k)], pa.array(n)], names=names)

    schema = _schema(names, [pa.int32(), *[pa.int64()] * (k + 1)])
    return _with_heavy(coded, heavy).mapInArrow(of, schema)


def _with_heavy(coded: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Blocks with the heavy prefixes that occur in them, a list of arrays of numbers."""
    columns = [B.BLOCK, "ids", "groups", "sequence"]
    if heavy is None:
        return coded.select(*columns, F.lit(None).cast("array<array<long>>").alias("known"))
    known = heavy.groupBy(B.BLOCK).agg(F.collect_list("prefix").alias("known"))  # prefixes within one block
    return coded.select(*columns).join(known, B.BLOCK, "left").select(*columns, "known")


def _is_heavy(ids: np.ndarray, rows: np.ndarray, known: list[list[int]] | None, k: int) -> np.ndarray:
    """Which rows of indices are among the heavy prefixes of ``k`` words."""
    heavy = {tuple(p) for p in known or () if len(p) == k}
    if not heavy or not len(rows):
        return np.zeros(len(rows), bool)
    different, back = np.unique(rows, axis=0, return_inverse=True)
    return np.array([tuple(p) in heavy for p in ids[different].tolist()])[back.ravel()]


_SENT = ["grp", "least", "dictionary", "suffixes", "counts"]
_SENT_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _sent(coded: DataFrame, heavy: DataFrame | None, n_groups: int) -> DataFrame:
    """The different suffixes of each block, packed by group. ``least``: the length of the group's prefixes, 2 or more."""

    def of(batches):
        for batch in batches:
            for block, ids, groups, sequence, known in zip(*[c.to_pylist() for c in batch.columns]):
                ids, groups = _array(ids, np.int64), _array(groups, np.int64)
                rows, n = _different(_windows(_array(sequence, np.int32)), len(ids))
                group = groups[rows[:, 0]]
                least = np.full(len(rows), 2)
                far = group < 0  # the first word has too many
                for k in range(2, DEPTH + 1):
                    h = W.mixed(ids[rows[far, :k]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(k, dtype=np.uint64))
                    spread = (W.mixed(h.sum(axis=1, dtype=np.uint64)) % np.uint64(n_groups)).astype(np.int64)
                    group[far], least[far] = -1 - (spread * DEPTH + k), k
                    if k < DEPTH:
                        at = np.flatnonzero(far)
                        far[at] = _is_heavy(ids, rows[at, :k], known, k)
                    if not far.any():
                        break
                order = np.argsort(group, kind="stable")
                names, first = np.unique(group[order], return_index=True)
                out = []
                for name, own in zip(names.tolist(), np.split(order, first[1:])):
                    local, index = np.unique(rows[own], return_inverse=True)
                    index = index.reshape(-1, DEPTH).T
                    small = index.astype(np.uint16 if len(local) <= 1 << 16 else np.uint32)
                    out.append((name, int(least[own[0]]), _packed(ids[local]), _packed(small), _packed(n[own])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT_TYPES)], names=_SENT)

    return _with_heavy(coded, heavy).mapInArrow(of, _schema(_SENT, _SENT_TYPES))


_NODE = [*[f"w{i + 1}" for i in range(DEPTH)], "d", "f"]
_NODE_TYPES = [*[pa.int64()] * DEPTH, pa.int32(), pa.int64()]


def _subtrees(sent: DataFrame, least: int) -> DataFrame:
    """(w1..w4, d, f): the nodes of at least ``least`` occurrences of each group's subtrees."""

    def grown(table: pa.Table) -> pa.Table:
        begin = table.column("least")[0].as_py()
        parts, counts = [], []
        for words, suffixes, n in zip(*[table.column(c).to_pylist() for c in _SENT[2:]]):
            words, n = _array(words, np.int64), _array(n, np.int64)
            index = _array(suffixes, np.uint16 if len(words) <= 1 << 16 else np.uint32).reshape(DEPTH, -1)
            parts.append(words[index])
            counts.append(n)
        words, index = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        rows, counts = index.reshape(DEPTH, -1).astype(np.int32), np.concatenate(counts)
        order = np.lexsort(rows[::-1])
        rows, counts = rows[:, order], counts[order]
        new = np.zeros(rows.shape[1], bool)
        new[0] = True
        out = []
        for k in range(DEPTH):
            new[1:] |= rows[k, 1:] != rows[k, :-1]
            if k + 1 < begin:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            kept = (total >= least) & (words[rows[k, first]] > 0)
            first, total = first[kept], total[kept]
            cells = [words[rows[i, first]] if i <= k else np.zeros(len(first), np.int64) for i in range(DEPTH)]
            out.append(pa.table([*[pa.array(c) for c in cells], pa.array(np.full(len(first), k + 1, np.int32)), pa.array(total)], names=_NODE))
        return pa.concat_tables(out)

    return sent.groupBy("grp").applyInArrow(grown, _schema(_NODE, _NODE_TYPES))


def vocabulary(coded: DataFrame) -> DataFrame:
    """(lang, word, id, f) of the frequent words, and with an empty word the number of all words of a language."""

    def of(batches):
        for batch in batches:
            for lang, lengths, words, counts, ids in zip(*[c.to_pylist() for c in batch.columns]):
                cells = _binary(_array(words, np.uint8), _array(lengths, np.uint32).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(cells)), cells.cast(pa.large_string()).cast(pa.string()), pa.array(_array(ids, np.int64)), pa.array(_array(counts, np.int64))],
                    names=["lang", "word", "id", "f"],
                )

    return coded.where("sequence IS NULL").select("lang", "lengths", "words", "counts", "ids").mapInArrow(of, "lang string, word string, id long, f long")


def counted(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, block_bytes: int = B.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, words): phrases of two words or more with their counts, and the vocabulary; both written."""
    arrow_batches(docs.sparkSession)
    coded = cut(encoded(docs, least, budget, block_bytes))
    words = cut(vocabulary(coded))
    texts = coded.where("sequence IS NOT NULL")
    many = words.where((F.col("f") > budget) & (F.col("word") != "")).agg(F.sum("f")).first()[0]
    heavy, heavies, nodes = None, [], None
    if many:
        for k in range(2, DEPTH):
            found = cut(_prefixes(texts, heavy, k))
            own = [f"w{i + 1}" for i in range(k)]
            large = cut(found.groupBy(*own).agg(F.sum("n").alias("f")).where(F.col("f") > budget))
            there = cut(found.join(large, own).select(B.BLOCK, F.array(*own).alias("prefix"), "f"))
            uncut(found)
            padded = large.select(*own, *[F.lit(0).cast("long").alias(c) for c in _NODE[k:DEPTH]], F.lit(k).alias("d"), "f")
            heavies += [large, there]
            if large.isEmpty():
                break
            nodes = padded if nodes is None else nodes.unionByName(padded)
            heavy = there if heavy is None else heavy.unionByName(there)
    trees = _subtrees(_sent(texts, heavy, max(1, -(-(many or 0) // budget))), least)
    nodes = cut(trees if nodes is None else trees.unionByName(nodes.where(F.col("f") >= least)))
    uncut(coded, *heavies)
    return nodes, words


def _part(begin: int, size: int) -> Column:
    """Words ``begin`` to ``begin + size - 1`` of a node as a key."""
    return F.struct(*[(F.col(f"w{begin + i + 1}") if i < size else F.lit(0).cast("long")).alias(f"w{i + 1}") for i in range(DEPTH)])


def _score() -> Column:
    """Exact in decimals: the product may pass 64 bits."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long")


def collocations(
    docs: DataFrame, least: int = LEAST, most: int = MOST, budget: int = BUDGET, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to four words by score."""
    nodes, words = counted(docs, least, budget, block_bytes)
    single = words.where(F.col("word") != "")
    key = F.struct(*[F.col(c) for c in _NODE[:DEPTH]])
    own = nodes.select(key.alias("phrase"), "d", F.col("f").alias("a"), *_NODE[:DEPTH])
    alone = single.select(F.struct(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(c) for c in _NODE[1:DEPTH]]).alias("part"), "f")
    parts = nodes.select(key.alias("part"), "f").unionByName(alone)

    cuts = [
        F.when(F.col("d") == d, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _part(*at).alias("part")))
        for d in range(2, DEPTH + 1)
        for k in range(1, d)
        for side, at in ((0, (0, k)), (1, (k, d - k)))
    ]
    asked = own.select("phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select("phrase", "a", "c.*")
    sides = asked.join(parts, "part").groupBy("phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == i, F.col("f"))).alias(c) for i, c in enumerate("lr")])
    best = sides.withColumn("score", _score()).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = [
        F.when(F.col("d") == d, _part(begin, size))
        for d in range(3, DEPTH + 1)
        for size in range(2, d)
        for begin in range(d - size + 1)
    ]
    longer = own.select(F.explode(F.filter(F.array(*inner), lambda c: c.isNotNull())).alias("phrase"), F.col("a").alias("f"))
    longest = longer.groupBy("phrase").agg(F.max("f").alias("longer"))
    share, whole = NESTED
    left = best.join(longest, "phrase", "left").where(f"longer IS NULL OR CAST({whole} AS DECIMAL(5,0)) * CAST(longer AS DECIMAL(19,0)) < CAST({share} AS DECIMAL(5,0)) * CAST(a AS DECIMAL(19,0))")

    each = left.select("phrase", "a", "best", F.posexplode(F.array(*[F.col(f"phrase.{c}") for c in _NODE[:DEPTH]])).alias("place", "id")).where("id > 0")
    texts = each.join(single.select("id", "lang", "word"), "id").groupBy("phrase", "a", "best", "lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))  # at most DEPTH
    named = texts.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")

    # first within a part of a language, so that no task sorts a whole language
    order = "ORDER BY score DESC, a DESC, phrase"
    first = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("place") <= most)
    ranked = first.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= most)
    totals = words.where(F.col("word") == "").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
