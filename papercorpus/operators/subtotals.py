"""Ratios that do not add up, for several groupings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text


def diversity_by_sets(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """duplicate_rate, distinct_1 and distinct_2 for each grouping in ``sets``, with the columns it leaves out null.

    ``rows``: (prediction, ...). Also returned is ``grouping``, the names of the set's columns
    joined by commas ('' for the whole), which tells a left-out column from a null value.
    Texts are exploded into values once and counted for the finest grouping; the grouping
    sets then repeat these counts, not the rows, and a value of a coarser group is counted
    once however many finer groups hold it. No rows give no result.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    stripped = text.strip(F.coalesce("prediction", F.lit(""))).alias("_whole")
    worded = rows.select(*columns, stripped, text.words(F.col("prediction")).alias("_tokens"))
    tokens = F.col("_tokens")
    grams = F.concat(arrays.tagged_ngrams(tokens, 1), arrays.tagged_ngrams(tokens, 2))
    whole = F.struct(F.lit(0).alias("n"), F.col("_whole").alias("gram"))
    typed = F.transform(grams, lambda g: F.struct(g["n"].cast("int").alias("n"), g["gram"].alias("gram")))
    values = worded.select(*columns, F.inline(F.concat(F.array(whole), typed)))
    counted = values.groupBy(*columns, "n", "gram").agg(F.count("*").alias("seen"))

    wanted = [[F.col("n"), F.col("gram"), *(F.col(c) for c in s)] for s in sets]
    kept = counted.groupingSets(wanted, F.col("n"), F.col("gram"), *(F.col(c) for c in columns)).agg(
        F.sum("seen").alias("seen"), *(F.grouping(c).alias(f"_no_{k}") for k, c in enumerate(columns)))
    left_out = [f"_no_{k}" for k in range(len(columns))]
    sums = kept.groupBy(*left_out, *columns, "n").agg(F.count("*").alias("kinds"), F.sum("seen").alias("seen"))
    ratio = F.col("kinds") / F.col("seen")
    found = sums.groupBy(*left_out, *columns).agg(*(F.max(F.when(F.col("n") == n, ratio)).alias(f"r{n}") for n in range(3)))
    names = F.concat_ws(",", *(F.when(F.col(f"_no_{k}") == 0, F.lit(c)) for k, c in enumerate(columns))) if columns else F.lit("")
    zero = F.lit(0.0)
    return found.select(names.alias("grouping"), *columns, (1 - F.col("r0")).alias("duplicate_rate"),
                        F.coalesce("r1", zero).alias("distinct_1"), F.coalesce("r2", zero).alias("distinct_2"))
