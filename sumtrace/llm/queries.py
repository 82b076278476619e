"""The operators as registered queries over a folder of tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrace.llm import bpe, decontaminate, dialogue, digest, fertility, language, licenses, pages, phrases, ppm, simhash, substrings, toxicity
from sumtrace.llm.common import fold
from sumtrace.llm.oracle import SQL


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.trained(docs, _table(spark, folder, "labels"), fold("doc_id", 4) != 2)
    return toxicity.scored(docs, model).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "flagged",
    )


def op4_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judged(_table(spark, folder, "documents"))


def op5_ppm(spark: SparkSession, folder: str) -> DataFrame:
    out = ppm.scored(_table(spark, folder, "documents"), fold("doc_id", 10) != 0)
    return out.withColumn("held_out", fold("doc_id", 10) == 0)


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.trained(docs, fold("doc_id", 5) != 0)
    return language.identified(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licensed(_table(spark, folder, "documents"))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.without_repeats(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pages(spark: SparkSession, folder: str) -> DataFrame:
    out = pages.extracted(_table(spark, folder, "pages"), pages.trained())
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encoded(_table(spark, folder, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decoded(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.digested(dialogue.repaired(dialogue.damaged(_table(spark, folder, "conversations"))))


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return digest.fingerprinted(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_decontaminate": op2_decontaminate,
        "op3_toxicity": op3_toxicity,
        "op4_fertility": op4_fertility,
        "op5_ppm": op5_ppm,
        "op6_language": op6_language,
        "op7_licenses": op7_licenses,
        "op8_substrings": op8_substrings,
        "op9_pages": op9_pages,
        "op10_bpe": op10_bpe,
        "op11_phrases": op11_phrases,
        "op12_conversations": op12_conversations,
        "op13_fingerprints": op13_fingerprints,
        "pipeline": pipeline,
    }


def oracle() -> dict[str, str]:
    return SQL
