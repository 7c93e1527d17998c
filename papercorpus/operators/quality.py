"""Reference-free and lexical quality metrics of predicted titles, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import jaccard, tagged, tagged_ngrams
from ..functions.text import strip, word_count, words
from ..functions.vectors import cosine
from .cleaning import one_of_each

# Names of the metrics, and the score that marks a failure.
FAILED = -1.0
ROW_METRICS = [
    "empty_rate", "length_compliance_rate", "avg_title_words", "compression_ratio_mean",
    "exact_match_rate", "jaccard_title_reference_mean",
]
CORPUS_METRICS = ["duplicate_rate", "distinct_1", "distinct_2"]
SEMANTIC_METRICS = ["semantic_cosine_mean", "semantic_failed"]


def _share(condition: Column) -> Column:
    return _mean(condition.cast("double"))


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def semantic_metrics(score: Column | None) -> list[Column]:
    """Mean and failure flag; one missing score fails the group, as does no score."""
    if score is None:
        return [F.lit(FAILED).alias("semantic_cosine_mean"), F.lit(1.0).alias("semantic_failed")]
    whole = (F.count("*") > 0) & (F.count(score) == F.count("*"))
    return [
        F.when(whole, F.avg(score)).otherwise(FAILED).alias("semantic_cosine_mean"),
        F.when(whole, 0.0).otherwise(1.0).alias("semantic_failed"),
    ]


def row_metrics(
    rows: DataFrame, by: Sequence[str], min_words: int, max_words: int, score: Column | None
) -> DataFrame:
    """Metrics that are means over rows: one pass, one small pre-aggregated shuffle."""
    scored = rows.select(
        *by,
        strip(F.col("prediction")).alias("p"),
        strip(F.col("reference")).alias("r"),
        words(F.col("prediction")).alias("p_words"),
        words(F.col("reference")).alias("r_words"),
        F.greatest(word_count(F.col("abstract")), F.lit(1)).alias("source_size"),
        (F.lit(None).cast("double") if score is None else score).alias("score"),
    ).withColumn("size", F.size("p_words"))
    return scored.groupBy(*by).agg(
        _share(F.col("size") == 0).alias("empty_rate"),
        _share(F.col("size").between(min_words, max_words)).alias("length_compliance_rate"),
        _mean(F.col("size")).alias("avg_title_words"),
        _mean(F.col("size") / F.col("source_size")).alias("compression_ratio_mean"),
        _share(F.lower("p") == F.lower("r")).alias("exact_match_rate"),
        _mean(jaccard(F.col("p_words"), F.col("r_words"))).alias("jaccard_title_reference_mean"),
        *semantic_metrics(None if score is None else F.col("score")),
    )


def corpus_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Duplicate rate and distinct n-gram ratios over each group.

    Whole predictions (n = 0), words and word pairs are exploded once and counted
    in one shuffle.  Counts are merged before it, so a frequent n-gram is cheap;
    ``count(distinct)`` three times over would multiply the rows instead.
    """
    tokens = F.col("tokens")
    pieces = F.concat(
        tagged(F.array(strip(F.col("prediction"))), 0),
        tagged_ngrams(tokens, 1),
        tagged_ngrams(tokens, 2),
    )
    counted = (
        rows.select(*by, "prediction", words(F.col("prediction")).alias("tokens"))
        .select(*by, F.inline(pieces))
        .groupBy(*by, "n", "gram")
        .agg(F.count("*").alias("seen"))
    )

    def distinct(n: int) -> Column:
        here = F.col("n") == n
        return F.coalesce(F.count(F.when(here, 1)) / F.sum(F.when(here, F.col("seen"))), F.lit(0.0))

    empty = F.sum(F.when(F.col("n") == 0, F.col("seen"))).isNull()
    return counted.groupBy(*by).agg(
        F.when(empty, 0.0).otherwise(1.0 - distinct(0)).alias("duplicate_rate"),
        distinct(1).alias("distinct_1"),
        distinct(2).alias("distinct_2"),
    )


def quality_scorecard(
    rows: DataFrame,
    by: Sequence[str] = (),
    min_words: int = 4,
    max_words: int = 15,
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """All quality metrics, one row per group.

    ``rows`` has prediction, reference and abstract, and the two sentence-vector
    columns named in ``vectors`` if the semantic score is wanted.  Without ``by``
    an empty table gives one row of zeros.
    """
    score = None if vectors is None else cosine(F.col(vectors[0]), F.col(vectors[1]))
    means = row_metrics(rows, by, min_words, max_words, score)
    ratios = corpus_metrics(rows, by)
    if by:
        right = ratios.withColumnsRenamed({key: f"_{key}" for key in by})
        same = [means[key].eqNullSafe(right[f"_{key}"]) for key in by]  # null is a group too
        return means.join(right, same).select(
            *by, *ROW_METRICS, *CORPUS_METRICS, *SEMANTIC_METRICS
        )
    single = [ratios.select(name).scalar().alias(name) for name in CORPUS_METRICS]
    return means.select(*ROW_METRICS, *single, *SEMANTIC_METRICS)


def attach_vectors(rows: DataFrame, vectors: DataFrame, on: str = "id") -> DataFrame:
    """Add supplied sentence vectors; rows without one keep a null, a repeated key is an error."""
    return rows.join(one_of_each(vectors, on), on, "left")
