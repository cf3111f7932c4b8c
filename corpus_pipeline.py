"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. Cases that a stage defines are in its operator's docstring:
nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns pass through as stated there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ocellus.llm.common import delete, shared_folder
from ocellus.llm.ngram_jaccard import drop_near_duplicates
from ocellus.llm.packing import pack_documents
from ocellus.llm.pii import mask_pii
from ocellus.llm.quality_rules import keep_good
from ocellus.llm.source_mixing import mixed_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that break an adaptive rule go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of similar documents, the one with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data is masked; every document stays."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in curriculum order, as often as the schedule reads them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sequences of packed documents, with their text, neighbourhood by neighbourhood of the curriculum's order."""
    return pack_documents(docs, by_file=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: Weak supervision and best-fit packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Hand-overs are Parquet tables in the cluster's shared folder, removed at the end."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir)  # its tables are checkpointed and hold the text: it reads docs no more
    finally:
        delete(spark, folder)
