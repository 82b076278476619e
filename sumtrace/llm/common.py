"""What several operators share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 2 << 20
BATCH_ROWS = 1024


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes too: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, by: str, most: int) -> list:
    """About ``most`` rows for each value of ``by``, chosen by hash of the row, on the driver.

    The number kept per value is binomial around ``most``: values with fewer rows are kept whole.
    Sorted by that hash, so the order is as good as random and the same each time.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(1)), F.lit(1 << 40))
    keep = F.lit(False)
    for value, size in sizes.items():
        share = min(1.0, most / size)
        keep = keep | ((F.col(by) == F.lit(value)) & (drawn < F.lit(int(share * (1 << 40)))))
    return sorted(rows.where(keep).collect(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode() + b"#"))
