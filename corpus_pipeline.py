"""A corpus in five stages: language, near-duplicates, repeated passages, test items, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept; its result
is written as Parquet and read again as the next one's documents. All but the last return the columns
of ``docs``. The near-duplicate and test-item stages name each row by a digest of all its columns and judge it
by its own text, as ids may be null or repeated. Only names and fingerprints move: rows that a filter of fixed
size over the names of rows to go lets through are compared with these names, the others stay where they are.
Rows without doc_id are near-duplicates of one another only, so a copy of a row with an id stays, once. Columns
of any name pass unchanged. Texts may be of any length, null or empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrace.llm import bitmap, bpe, decontaminate, language, simhash, substrings
from sumtrace.session import cut, only_kept, uncut

#: Bits (a power of two) of the filter over rows to go: 8 MB. Beyond some ten million rows to go it lets ever more pass.
FILTER_BITS = 26


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised, or that have no letter."""
    return language.accepted(docs, language.trained(docs, F.lit(True)))


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their digest in a column whose name no other has."""
    key = "digest"
    while key in docs.columns:
        key += "_"
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return docs.withColumn(key, F.sha2(whole, 256)), key


def _less(named: DataFrame, key: str, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows but those whose digest is in ``gone``; of equal rows whose digest is in ``once`` one stays."""
    touched = gone if once is None else gone.unionByName(once)
    filter_ = bitmap.build(touched.select(F.xxhash64(key).alias("hash")), FILTER_BITS)
    maybe = bitmap.may_hold(named, filter_, F.xxhash64(key))
    rest = named.where(maybe)
    rest = rest if once is None else rest.dropDuplicates([key])
    return named.where(~maybe).unionByName(rest.join(gone, key, "left_anti")).drop(key)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the row with the least id, and one of those without an id."""
    named, key = _named(docs)
    rows, classes = simhash.grouped(named, keep=(key,))
    group = [F.col("root"), F.col("doc_id").isNull().alias("no_id")]
    kinds = rows.join(classes.select("fp", "root"), "fp").groupBy(*group, "doc_id", key).agg(F.count("*").alias("n"))
    first = kinds.groupBy("root", "no_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
    judged = kinds.join(first, ["root", "no_id"]).select(key, (F.col(key) != F.col(f"first.{key}")).alias("gone"), "n")
    touched = cut(judged.where("gone OR n > 1"))
    uncut(rows, classes)
    return _less(named, key, touched.where("gone").select(key), touched.where("NOT gone").select(key))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out that a document with a smaller id has too; every document stays as a row."""
    return substrings.cleaned(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, key = _named(docs)
    return _less(named, key, decontaminate.rows_with_items(named, items, key))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether they decode to the text again."""
    ids = bpe.encoded(docs).select("doc_id", F.col("ids"), F.size("ids").cast("long").alias("n_tokens"))
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    back = bpe.decoded(ids.select("doc_id", "n_tokens", digest, "ids"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_passages),
    ("test_items", without_test_items),
    ("token_ids", token_ids),
]

#: Language identification is trained and token ids need a vocabulary; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with only_kept(spark):
            docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            uncut(before)
        before = docs
    return docs
