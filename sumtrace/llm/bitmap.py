"""A filter of fixed size over 64-bit hashes, built by Spark and sent to every task.

The filter has a set number of bits, whatever the number of hashes, so its broadcast has a
proven bound. It never misses a hash that was put in; the more it holds, the more others it lets
through. It only spares work: what passes is checked exactly later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 15  # a group holds 2**15 bits


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places per hash in a filter of ``2**bits`` bits."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def build(hashes: DataFrame, bits: int) -> np.ndarray:
    """Filter with all values of the single BIGINT column ``hash``; bits (at most 32) as bytes."""

    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(positions(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> _CHUNK), pa.array(at)], names=["chunk", "at"])

    def packed(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << _CHUNK, np.uint8)
        on[table.column("at").to_numpy() & ((1 << _CHUNK) - 1)] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bytes": [np.packbits(on, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    chunks = (
        hashes.where("hash is not null")
        .mapInArrow(places, "chunk long, at long")
        .distinct()
        .groupBy("chunk")
        .applyInArrow(packed, "chunk long, bytes binary")
    )
    size = 1 << (_CHUNK - 3)
    for chunk, data in chunks.toLocalIterator():
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(data, np.uint8)[: len(out)]
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    bits = int(len(bitmap)).bit_length() + 2
    first, second = positions(hashes, bits)
    out = (bitmap[first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(out)
    at = second[some]
    out[some] = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def may_hold(df: DataFrame, bitmap: np.ndarray, hashes: Column) -> Column:
    """Whether each BIGINT of a column may be in the filter; only this column goes to Python."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def of(cells: pa.Array) -> pa.Array:
        return pa.array(holds(sent.value, cells.to_numpy(zero_copy_only=False).view(np.uint64)))

    return of(hashes)
