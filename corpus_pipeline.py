"""Corpus pipeline over ``documents``: quality, language, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import forest, language, packing, quality
from leafmill.llm.batches import importable, written
from leafmill.llm.queries import ARROW_ROWS, WORD_MODEL

#: Languages of the corpus; documents in others, and text that is no language, go.
WANTED = ["de", "en", "es", "fr"]


def only(docs: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose document is kept; a null doc_id cannot be judged, and stays."""
    gone = judged.filter("NOT kept").select(judged[key].alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")


def ready(spark: SparkSession) -> SparkSession:
    """Session whose tasks can import the package and get texts in small batches."""
    importable(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return only(docs, quality.classify(docs, labels), "doc_id")


def documents_of_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return only(docs, language.identify(language.of_documents(docs), WANTED), "id")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return only(docs, forest.near_duplicates(docs), "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, WORD_MODEL, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("language ID", documents_of_a_language),
    ("MinHash near-dedup", one_of_each_group),
    ("packing", packed),
]

#: No stage but by models, signatures and tokenizers: SQL cannot express it; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages one after the other, each on the written result of the one before."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
