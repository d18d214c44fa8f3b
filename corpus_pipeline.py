"""A training corpus from raw documents, stage by stage.

Each stage takes all rows that the one before kept. The last one returns the
packed token pieces, the others the columns of documents.
"""

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tierpick
from tierpick.llm import decontam, dedup, jaccard, packing, toxicity
from tierpick.session import stage

# Python workers may start in another folder.
cloudpickle.register_pickle_by_value(tierpick)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the largest doc_id."""
    return dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the smallest doc_id."""
    return jaccard.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", benchmark_out),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # trees, components and packing can't be expressed


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
