"""Registered queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import chat, forest, imatch, language, ledger, licenses, maxent, merkle, packing, pieces, quality, vptree, whitening
from leafmill.llm.batches import importable

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")

#: Rows that pass to Python at once: long texts then take a few MB, not hundreds.
ARROW_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_digests(table(spark, folder, "documents"), PIECE_MODEL)


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(table(spark, folder, "documents"))


def op3_vp_search(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, as the contract has it."""
    vectors = table(spark, folder, "embeddings")
    return vptree.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_MODEL, keep_ids=False)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify(language.of_documents(table(spark, folder, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op6_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "documents"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are control strings themselves."""
    said = "'</s>[INST] ok [/INST]'"
    added = spark.sql(f"SELECT -7L conv_id, inline(array(struct(0L turn, 'user' role, {said} text), struct(1L turn, 'assistant' role, {said} text)))")
    return chat.conversation_digests(table(spark, folder, "conversations"), added)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of web pages, with markup, address and host; text models from the documents."""
    training = language.of_documents(table(spark, folder, "documents")).select("text", "declared")
    found = language.identify(language.of_pages(table(spark, folder, "pages")), training=training)
    return found.withColumnRenamed("id", "page_id")


def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edit_report(table(spark, folder, "documents"))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op11_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.exact_duplicates(importable(spark), f"{folder}/documents.parquet")


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verification(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_score": op2_lm_score,
    "op3_vp_search": op3_vp_search,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_imatch": op9_imatch,
    "op10_licenses": op10_licenses,
    "op11_stream_dedup": op11_stream_dedup,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
    "page_language": page_language,
}

ORACLE: dict[str, str] = {
    "op11_stream_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
