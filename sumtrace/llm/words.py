"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes that holds none of the six separators space, tab, line feed,
vertical tab, form feed and carriage return (``[^\\x20\\x09-\\x0D]+``). Texts are UTF-8, so
no separator byte ever occurs inside a character. Word hashes have 64 bits: each byte is
multiplied by a random number that belongs to its place in the word, the products are
summed, and the sum is mixed with the length.

Null texts count as empty. A text without words has no entry in the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
"""Texts are worked through in pieces of about this many bytes (one text at least)."""

_PLACES = 4096


def _random_odd(n: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _random_odd(_PLACES, 20_231)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of a piece of texts: byte spans, the text each is in, and where texts begin."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    text: np.ndarray  # index of the text of each word
    first: np.ndarray  # index of the first word of each text, and at last the number of words

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text each, with bytes and offsets."""
    data, at = buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin), data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def split(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    """Find the words. ``separator``: which of the 256 byte values part words."""
    gap = separator[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def hashed(words: Words, longest: int | None = None) -> np.ndarray:
    """64-bit hash of each word; of its first ``longest`` bytes only, if given."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    size = words.end - words.start
    if longest is not None:
        size = np.minimum(size, longest)
    at = np.cumsum(size) - size
    place = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
    byte = words.data[place + np.repeat(words.start, size)].astype(np.uint64) + np.uint64(1)
    factor = _PLACE[place & (_PLACES - 1)]
    if size.max() > _PLACES:
        factor = factor * (2 * (place // _PLACES) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(byte * factor, at) + size.astype(np.uint64))


def runs(words: Words, hashes: np.ndarray, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` consecutive words of one text, and the index of its first word.

    ``lane`` picks one of several independent hash functions.
    """
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = _random_odd(n, 77 + 1000 * lane + n)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h += hashes[k : k + total] * factors[k]
    inside = words.text[:total] == words.text[n - 1 :]
    return mixed(h[inside]), np.flatnonzero(inside)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a word sequence as one run."""
    factors = _random_odd(len(hashes), 77 + len(hashes))
    return mixed(np.sum(hashes * factors, keepdims=True))[0]
