"""Distinct counts from stored sketches, merged without going back to the texts.

A HyperLogLog sketch of 2^LG_K places has a standard error of about 0.8 / sqrt(2^LG_K), 0.65 % here,
and a size of at most 16 KB. Sketches of runs, splits or days are stored once and
merged into any larger group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text

LG_K = 14


def diversity_sketches(rows: DataFrame, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(by..., measure, total, sketch) for the predictions and their one- and two-word n-grams.

    ``rows``: (prediction, ...). Predictions are stripped, null counts as ''; measures are
    ``prediction``, ``distinct_1`` and ``distinct_2``, those with no value left out. Sketches are built in each
    task and merged after the shuffle, so a frequent group is no hot task.
    """
    stripped = text.strip(F.coalesce("prediction", F.lit(""))).alias("_whole")
    worded = rows.select(*by, stripped, text.words(F.col("prediction")).alias("_tokens"))
    tokens = F.col("_tokens")
    grams = F.transform(F.concat(arrays.tagged_ngrams(tokens, 1), arrays.tagged_ngrams(tokens, 2)),
                        lambda g: F.struct(F.concat(F.lit("distinct_"), g["n"].cast("string")).alias("measure"), g["gram"].alias("value")))
    whole = F.array(F.struct(F.lit("prediction").alias("measure"), F.col("_whole").alias("value")))
    values = worded.select(*by, F.inline(F.concat(whole, grams)))
    return values.groupBy(*by, "measure").agg(F.count("*").alias("total"), F.hll_sketch_agg("value", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The stored sketches merged into the coarser groups ``by``."""
    return sketches.groupBy(*by, "measure").agg(F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """The estimated number of distinct values and its share of all values, instead of the sketch."""
    estimate = F.hll_sketch_estimate("sketch")
    return sketches.withColumn("distinct", estimate).withColumn("ratio", F.col("distinct") / F.col("total")).drop("sketch")
