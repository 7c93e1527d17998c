"""Split papers -> prompts -> predictions (stored once) -> metric tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import INSTRUCTION, mode_label
from ..operators.overlap import text_metrics
from ..operators.quality import quality_scorecard
from ..operators.reporting import metric_long_table
from ..operators.sampling import default_key, evaluation_cap
from ..operators.scoring import Predictor, example_block, few_shot_examples, predict_titles
from ..sources.shared import stored


def predict_splits(
    papers: DataFrame,
    make_predictor: Callable[[], Predictor],
    splits: Sequence[str] = ("val", "test"),
    key: str | None = None,
    num_shots: int = 0,
    seed: int = 42,
    few_shot_seed: int | None = None,
    max_rows: int = 0,
    instruction: str = INSTRUCTION,
    max_words: int = 15,
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """Predictions for the chosen splits as a stored table.

    ``key`` names a unique column (default: row_key, or else id).
    The rows are dealt out evenly to ``partitions`` tasks (default: one per core,
    0: as they lie), since a prediction costs far more than moving its row.

    Storing matters: metrics and outputs read the table several times, and the
    predictor is by far the most expensive step.
    """
    chosen = papers.filter(F.col("split").isin(list(splits)))
    by_key = F.col(key) if key else default_key(papers)
    chosen = evaluation_cap(chosen, max_rows, seed, by_key)
    if partitions is None:
        partitions = papers.sparkSession.sparkContext.defaultParallelism
    if partitions:
        chosen = chosen.repartition(partitions)
    block = None
    if num_shots > 0:
        train = papers.filter(F.col("split") == "train")
        shot_seed = seed if few_shot_seed is None else few_shot_seed
        block = example_block(few_shot_examples(train, num_shots, shot_seed, by_key))
    predicted = predict_titles(chosen, make_predictor, instruction, block, max_words, **options)
    return stored(predicted.withColumn("mode", F.lit(mode_label(num_shots))), "predictions")


def scored_rows(predictions: DataFrame) -> DataFrame:
    """Column names as the metric operators want them."""
    return predictions.withColumnsRenamed({"predicted_title": "prediction", "title": "reference"})


def evaluate(
    predictions: DataFrame,
    by: Sequence[str] = ("split",),
    metrics: Iterable[str] | None = None,
    stem: bool = True,
    token_vectors: tuple[str, str] | None = None,
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Long table (by..., family, metric, value) of text and quality metrics.

    The two vector arguments name supplied columns: token vectors for the
    matching scores, sentence vectors for the semantic score.
    """
    rows = scored_rows(predictions)
    text = text_metrics(rows, by, metrics, stem, token_vectors)
    quality = quality_scorecard(rows, by, vectors=vectors)
    return metric_long_table(text, by, "text").unionByName(
        metric_long_table(quality, by, "quality")
    )
