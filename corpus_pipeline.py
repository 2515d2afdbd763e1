"""A corpus pipeline: quality, line deduplication, near-duplicates, benchmark decontamination, mixture.

Every stage takes the documents its predecessor kept; all but the last return the columns of documents. Their decisions:
quality drops what the classifier rejects; line_dedup cuts repeated lines, and drops documents that had words and have no line
left; near_duplicates keeps one document of each group; decontaminate cuts benchmark passages, and drops documents
that mostly consist of them; mix draws the target mixture and gives how often a document is in it. Nulls, empty texts,
repeated rows and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm import decontam, linededup, mixing, neardup, quality
from tsloom.llm.common import stored

#: SQL cannot express the classifier, nor the fuzzy stages at this size: tests hold the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs).where("n_dropped = 0 OR n_lines > n_dropped")
    return _sized(out).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(mixing.WEIGHTS, mixing.WEIGHTS_SCHEMA)
    return mixing.mix(docs, mixing.domain_of(F.col("source")), weights).where("epochs > 0")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
