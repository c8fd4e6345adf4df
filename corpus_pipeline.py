"""The corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what its predecessor kept, with the columns of documents; the last
one returns the packed pieces with their ids. Between stages the rows are written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import decontaminate, kneser_ney, retrieval_packing, simhash, suffix_dedup
from quarrylight.session import shared_folder, table

#: Words of a shingle, and the Jaccard similarity of the sets of shingles from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=SHINGLE, similarity=SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("retrieval_packing", packing),
]

#: No stage but the decontamination can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The rows between them go to the shared folder in spark.checkpoint.dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
