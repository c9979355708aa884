"""From crawled documents to packed training sequences, in stages that each hand on a table of documents.

Every stage judges all rows that the stage before kept, and what it rejects is gone. All but the last
return the columns of ``documents``, whatever they are; the last returns where each piece of each document
lies in the packed sequences. Nulls, ties, repeated rows and empty tables have the results that the
operators define: a null or blank text is rejected by the classifier or the rules; of rows with one id and
near-equal texts one stays; without labels the classifier rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runout.llm import decontamination, packing, quality_knn, quality_rules, simhash
from runout.llm.common import held_out, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for quality; a quarter of the ids never teaches."""
    return quality_knn.drop_rejected(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(packing.token_counts(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", reject_low_quality),
    ("quality_rules", reject_by_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the packing can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again as the next one's input."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
