"""Checkpoint choice and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import split_sizes


def best_checkpoint(
    checkpoints: DataFrame, metric: str = "eval_rougeL", greater_is_better: bool = True
) -> DataFrame:
    """Best row of each run; the earliest step wins a tie.

    Done as an aggregate, merged before the shuffle, so a run holding most of
    the rows is no single sorted task.  A missing metric is never the best.
    """
    value = F.col(metric) if greater_is_better else -F.col(metric)
    best = F.max_by(F.struct(*checkpoints.columns), F.struct(value, -F.col("step")))
    return (
        checkpoints.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
        .groupBy("run")
        .agg(best.alias("best"))
        .select("best.*")
    )


def newest_checkpoints(checkpoints: DataFrame, keep: int = 2) -> DataFrame:
    """The newest ``keep`` checkpoints of each run (cut to ``keep`` before the shuffle)."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))
    return checkpoints.withColumn("_place", place).filter(F.col("_place") <= keep).drop("_place")


def metric_long_table(
    metrics: DataFrame, by: Sequence[str], family: str, names: Sequence[str] | None = None
) -> DataFrame:
    """One row per group and metric: by..., family, metric, value."""
    names = list(names or [c for c in metrics.columns if c not in by])
    doubles = metrics.select(*by, *[F.col(n).cast("double").alias(n) for n in names])
    long = doubles.unpivot(list(by), names, "metric", "value")
    return long.select(*by, F.lit(family).alias("family"), "metric", "value")


def size_rows(papers: DataFrame) -> DataFrame:
    """Split sizes in the form of the long metric table."""
    return split_sizes(papers).select(
        "split",
        F.lit("dataset_sizes").alias("family"),
        F.lit("rows").alias("metric"),
        F.col("rows").cast("double").alias("value"),
    )


def tradeoff_table(metrics: DataFrame) -> DataFrame:
    """Per model and paradigm: ROUGE-1 and BERTScore F1 in percent.

    Takes the long metric table with model and paradigm columns; the pivot names
    its two values, so no extra pass looks for them.
    """
    wanted = ["rouge1", "bertscore_f1"]
    return (
        metrics.filter(F.col("metric").isin(wanted))
        .groupBy("model", "paradigm")
        .pivot("metric", wanted)
        .agg(F.round(F.avg("value") * 100, 2))
        .select(
            "model", "paradigm", F.col("rouge1").alias("rouge1_percent"),
            F.col("bertscore_f1").alias("bertscore_f1_percent"),
        )
    )


def human_summary(
    scores: DataFrame, settings: tuple[str, str] = ("zero_shot", "few_shot")
) -> DataFrame:
    """Mean score per model and criterion in both settings, and the change."""
    first, second = settings
    return (
        scores.groupBy("model", "criterion")
        .pivot("setting", [first, second])
        .agg(F.avg("score"))
        .withColumn("change", F.col(second) - F.col(first))
    )
