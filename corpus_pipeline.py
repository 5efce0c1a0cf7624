"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

The classifier drops documents of bad quality; of each group of near copies one stays; passages that occur earlier are
cut; secrets are replaced by a placeholder; what is left is packed into training windows.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns
of any name; what it does with them is stated where its operator is. All but the last give the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import materialize
from vellum.llm.jaccard import keep_one_of_each
from vellum.llm.packing import pack_documents
from vellum.llm.quality_classifier import keep_good
from vellum.llm.secrets import redact_secrets
from vellum.llm.substring import remove_repeats


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it is fitted on this stage's documents and their labels.

    Null and empty texts are judged by their figures; without labels of both kinds every document stays."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies; documents without words all stay."""
    return keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; a text that loses none stays as it is, a null one null."""
    return remove_repeats(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced; a text without any stays as it is, a null one null."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in training windows; a null or empty text gives one piece, its end id."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", drop_bad_quality),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL cannot express the classifier or the tokeniser; tests/llm/test_models.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder and read by the next.

    The tables of all but the last stage stay while the driver runs, as the result is read from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
