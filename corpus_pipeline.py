"""A corpus from raw documents to packed sequences, in stages that are written as Parquet and read again.

Language identification drops texts in no known language, line dedup removes lines that repeat an earlier one, near-copy
removal keeps one document of each group linked by 5-word Jaccard 0.8 or more (candidates from op8's SimHash index, and from bands what its bits cannot reach), decontamination drops documents with a benchmark window, packing lays the
rest out in sequences. All stages but the last return the columns of ``documents``; rows of the last are pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evenlend.llm import decontaminate, language, linededup, nearcopies, packing
from evenlend.session import checkpoint_root


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identify),
    ("line_dedup", dedup_lines),
    ("near_copies", dedup_documents),
    ("decontaminate", clean_benchmark),
    ("pack", pack),
]

# Tokens, fingerprints and learned language models are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one returns is written to the shared checkpoint folder and read again."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
