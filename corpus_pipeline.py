"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next stage. All
but the last return the columns of documents; the mix adds copy_no, one row per copy taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.llm import decontaminate, language, line_dedup, mixing, near_dup
from saccade.llm.common import dispose, read_table, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return language.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; documents of which nothing is left go."""
    return line_dedup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    gone = gone.withColumnRenamed("doc_id", "_gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: EM language sets and dependent rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables of the stages before it are removed when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            dispose(before)
        docs = before = spark.read.parquet(path)
    return docs
