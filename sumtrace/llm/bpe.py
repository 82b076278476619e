"""BPE encoding and decoding with a distinct-word table.

Texts are split into words by the vocabulary's own rule in Spark tasks. Each distinct word of a
block of documents is asked for once, each distinct word of all blocks is encoded once, by the
vocabulary's library, and the ids are joined back to every place where the word stands
(:mod:`blocks`). Ids and decoded texts equal those of the library on the whole text: a word that
the rule splits off encodes to the same ids alone as in its text.

Texts with characters from U+0250 on are split by the library's own rule; the others, by the same rule
written out for the characters below. Texts that contain a special token's string are encoded whole by
the library. Decoding joins ids to the bytes of their pieces; the vocabulary bounds that table.

The vocabulary file is a parameter: a tokenizers file with a byte-level BPE model, at a path that
exists on every machine, as the library that comes with it does.

Edge cases: a null text counts as empty and has no ids; null ids decode to an empty text and
unknown ids to nothing; bytes that are no UTF-8 decode to U+FFFD as in the library. Every row comes out
once, whether ids are null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrace.llm import blocks as B
from sumtrace.llm.common import arrow_batches, id_and_text

BUCKET_BYTES = 8 << 20
WORDS_AT_ONCE = 4096

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\x09-\x0d\x20\u0085 "
_WORD = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ɏ]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its share
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


@cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def split(text: str, path: str) -> list[str]:
    """Words of a text without special tokens."""
    if _OTHER.search(text):
        return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return _WORD.findall(text)


@cache
def pieces(path: str) -> list[bytes]:
    """Bytes of each id."""
    shown = {}  # the printable character that stands for each byte
    extra = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            shown[chr(b)] = b
        else:
            shown[chr(256 + extra)] = b
            extra += 1
    t = tokenizer(path)
    special = {i: token.content.encode() for i, token in t.get_added_tokens_decoder().items()}
    vocabulary = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = special[i] if i in special else bytes(shown[c] for c in piece)
    return out


class _Block:
    """Distinct words of a block, by bucket in the order in which it asks for them, and for each
    text the places of its words among the distinct ones; None for texts with special tokens."""

    def __init__(self, table: pa.Table, path: str, n_buckets: int):
        import xxhash

        place: defaultdict[str, int] = defaultdict()
        place.default_factory = place.__len__
        self.whole: dict[int, str] = {}
        self.texts: list[np.ndarray] = []
        specials = _specials(path)
        for i, cell in enumerate(table.column("text")):
            text = B.expand(cell.as_py()).decode()
            if any(s in text for s in specials):
                self.whole[i] = text
                self.texts.append(np.zeros(0, np.int32))
            else:
                words = split(text, path)
                self.texts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        self.buckets: list[list[bytes]] = [[] for _ in range(n_buckets)]
        self.places: list[list[int]] = [[] for _ in range(n_buckets)]
        for word in sorted(place):
            data = word.encode()
            i = xxhash.xxh3_64_intdigest(data) % n_buckets
            self.buckets[i].append(data)
            self.places[i].append(place[word])
        self.n_words = len(place)


def encoded(docs: DataFrame, path: str | None = None, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or default_vocabulary()
    dealt, n_blocks = B.dealt(id_and_text(docs), "text", block_bytes)
    n_buckets = max(1, n_blocks * block_bytes // BUCKET_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        own = _Block(table, path, n_buckets)
        used = [i for i, words in enumerate(own.buckets) if words]
        block = table.column(B.BLOCK)[0].as_py()
        sizes = [np.array([len(w) for w in own.buckets[i]], np.uint32).tobytes() for i in used]
        return pa.table(
            [
                pa.array([block] * len(used), pa.int32()),
                pa.array(used, pa.int32()),
                pa.array([B.squeeze(x) for x in sizes], pa.binary()),
                pa.array([B.squeeze(b"".join(own.buckets[i])) for i in used], pa.binary()),
            ],
            names=[B.BLOCK, "bucket", "lengths", "words"],
        )

    def reply(table: pa.Table) -> pa.Table:
        asked = [_words(B.expand(a), B.expand(b)) for a, b in zip(table.column("lengths").to_pylist(), table.column("words").to_pylist())]
        distinct = sorted(set().union(*asked))
        kind = _id_type(path)
        ids: dict[bytes, bytes] = {}
        for at in range(0, len(distinct), WORDS_AT_ONCE):
            part = distinct[at : at + WORDS_AT_ONCE]
            for word, e in zip(part, tokenizer(path).encode_batch([w.decode() for w in part], add_special_tokens=False)):
                ids[word] = np.array(e.ids, kind).tobytes()
        found = [[ids[w] for w in own] for own in asked]
        size = np.dtype(kind).itemsize
        counts = [(np.fromiter(map(len, own), np.uint32, len(own)) // size).astype(np.uint32).tobytes() for own in found]
        return pa.table(
            [
                table.column(B.BLOCK),
                table.column("bucket"),
                pa.array([B.squeeze(x) for x in counts], pa.binary()),
                pa.array([B.squeeze(b"".join(x)) for x in found], pa.binary()),
            ],
            names=[B.BLOCK, "bucket", "counts", "ids"],
        )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, path, n_buckets)
        count, begin = np.zeros(own.n_words, np.int64), np.zeros(own.n_words, np.int64)
        flat, seen = [np.zeros(0, np.int32)], 0
        for bucket, counts, ids in zip(*[answers.column(c).to_pylist() for c in ("bucket", "counts", "ids")]):
            n = np.frombuffer(B.expand(counts), np.uint32).astype(np.int64)
            at = np.array(own.places[bucket])
            count[at], begin[at] = n, seen + np.cumsum(n) - n
            flat.append(np.frombuffer(B.expand(ids), _id_type(path)).astype(np.int32))
            seen += len(flat[-1])
        known = np.concatenate(flat)
        words = np.concatenate([np.zeros(0, np.int32), *own.texts])
        n = count[words]
        end = np.concatenate([[0], np.cumsum(n)])
        joined = known[np.arange(end[-1]) + np.repeat(begin[words] - end[:-1], n)]
        offsets = end[np.cumsum([0] + [len(x) for x in own.texts])]
        if own.whole:
            values = np.split(joined, offsets[1:-1])
            for i, text in own.whole.items():
                values[i] = np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.int32)
            joined, offsets = np.concatenate(values), np.cumsum([0] + [len(v) for v in values])
        offsets = offsets.astype(np.int32)
        return pa.table([table.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined))], names=["doc_id", "ids"])

    return B.answered(
        B.squeezed(dealt),
        ask,
        f"{B.BLOCK} int, bucket int, lengths binary, words binary",
        reply,
        f"{B.BLOCK} int, bucket int, counts binary, ids binary",
        finish,
        T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]),
    )


def _id_type(path: str) -> type:
    return np.uint16 if tokenizer(path).get_vocab_size() <= 1 << 16 else np.uint32


def _words(lengths: bytes, words: bytes) -> list[bytes]:
    end = np.cumsum(np.frombuffer(lengths, np.uint32).astype(np.int64)).tolist()
    return [words[a:b] for a, b in zip([0, *end], end)]


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the column of ids replaced by ``decoded``, the text."""
    path = path or default_vocabulary()
    arrow_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != ids]
    ordered = rows.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`").alias("__ids"))
    schema = ordered.drop("__ids").schema.add("decoded", "string")

    def of(batches):
        table = pa.array([*pieces(path), b""], pa.large_binary())
        for batch in batches:
            texts = _joined(batch.column(len(others)), table)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], texts], names=[*others, "decoded"])

    return ordered.mapInArrow(of, schema)


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """Texts of lists of ids, by a table of the bytes of each id; its last entry, which is empty, serves all others."""
    ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
    ids = np.where((ids < 0) | (ids >= len(table) - 1), len(table) - 1, ids)
    ends = np.cumsum(np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy()]))
    _, places, data = table.take(pa.array(ids)).buffers()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(places, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = data[: at[-1]]
    offsets = at[ends]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    if not (data[starts] & 0xC0 == 0x80).any():  # no text begins within a character of the one before
        try:
            str(data, "utf-8")
            return pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        except UnicodeDecodeError:
            pass
    return pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
