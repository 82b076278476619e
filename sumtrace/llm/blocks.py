"""Questions and answers between blocks of rows and buckets of keys.

Some operators need, for every word or window of a text, something that depends on the whole
corpus. Joining single words would shuffle the corpus several times over. Instead, rows are dealt
into blocks of about equal size by a hash of their content; a block asks for each of its distinct
keys once, packed per bucket of keys; each bucket sees all questions about its keys and answers
them; and a block's rows meet the answers to its questions. A key that a third of all rows hold is
asked for once per block. Blocks and buckets have bounded sizes, whose number grows with the data.

Everything is a function of the rows in a block, not of their order, so a recomputed task gives
the same questions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrace.llm.common import arrow_batches

BLOCK_BYTES = 4 << 20
BLOCK = "__block"

Groups = Callable[[pa.Table], pa.Table]


def dealt(rows: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``rows`` with a column ``__block``, and the number of blocks.

    Equal rows go to different blocks where they lie in different partitions, so a block gets no more of
    them than a partition has. A partition's number, unlike a row's, does not depend on the order in
    which its rows come.
    """
    size = rows.agg(F.sum(F.octet_length(text).cast("long") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    hashed = F.xxhash64(*[F.col(c) for c in rows.columns if c in ("doc_id", text)], F.spark_partition_id())
    return rows.withColumn(BLOCK, F.pmod(hashed, F.lit(n)).cast("int")), n


def answered(
    blocks: DataFrame,
    ask: Groups,
    question: str,
    reply: Groups,
    answer: str,
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    result,
) -> DataFrame:
    """``finish`` of each block and the answers to its questions.

    ``ask`` makes of a block's rows questions with columns __block, bucket and more (``question`` is
    the schema), ``reply`` of all questions of a bucket answers with a column __block (``answer``).
    """
    arrow_batches(blocks.sparkSession)
    questions = blocks.groupBy(BLOCK).applyInArrow(ask, question)
    answers = questions.groupBy("bucket").applyInArrow(reply, answer)
    return blocks.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(finish, result)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes: what is shuffled is written to disk too."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the texts compressed; nulls count as empty."""
    arrow_batches(rows.sparkSession)
    at = rows.columns.index(text)
    schema = T.StructType([T.StructField(text, T.BinaryType()) if f.name == text else f for f in rows.schema.fields])

    def of(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            cells = [press.compress((x or "").encode()) for x in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(cells, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(of, schema)
