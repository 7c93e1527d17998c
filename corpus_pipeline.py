"""From raw documents to packed training sequences, stage by stage.

Quality rules, line dedup, near-duplicate removal, mixing of sources and packing. Each
stage gets all that the one before it kept, written and read again; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papercorpus.llm.line_dedup import dedup_lines
from papercorpus.llm.mixing import take
from papercorpus.llm.near_duplicates import keep_one_of_each
from papercorpus.llm.packing import pack
from papercorpus.llm.quality_rules import keep_good
from papercorpus.sources.shared import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    clean = dedup_lines(docs)
    left = clean.filter("n_removed = 0 or text <> ''")
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them."""
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bins they lie in."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

#: Best-fit packing cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{number}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
