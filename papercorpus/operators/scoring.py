"""Build prompts and score every row with a predictor supplied by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import INSTRUCTION, example_lines, title_prompt
from ..functions.text import clean_title
from .cleaning import one_of_each
from .sampling import seeded_order

Predictor = Callable[[list[str]], list[str]]

FEW_SHOT_CHARS = 1200  # fixed value: characters of an example's abstract that are shown


def few_shot_examples(
    train: DataFrame, num_shots: int, seed: int, key: Column, max_chars: int = FEW_SHOT_CHARS
) -> DataFrame:
    """Seeded sample of train rows as (number, abstract, title), the same as ``sample_rows`` draws.

    The examples of one prompt are few, so they are a top-k: every task keeps its first
    ``num_shots`` rows, already cut to what is shown, and one task merges them.
    """
    rows = train.select(
        seeded_order(seed, "shots", key).alias("order"),
        F.substring(F.coalesce("abstract", F.lit("")), 1, max_chars).alias("abstract"),
        F.coalesce("title", F.lit("")).alias("title"),
    )
    chosen = rows.orderBy("order").limit(max(num_shots, 0))
    listed = chosen.agg(F.array_sort(F.collect_list(F.struct("order", "abstract", "title"))).alias("r"))
    return listed.select(F.posexplode("r").alias("number", "row")).select(
        (F.col("number") + 1).alias("number"), "row.abstract", "row.title"
    )


def example_block(examples: DataFrame) -> Column:
    """The examples as one text, usable as a column; null when there are none.

    A scalar subquery: the few rows are put together once, and every row of the
    scored table reads the value without a join.
    """
    line = example_lines(F.col("number"), F.col("abstract"), F.col("title"))
    lines = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda e: e["line"]), "\n")
    block = F.when(F.count("*") > 0, F.concat(F.lit("Examples:\n"), text))
    return examples.agg(block.alias("block")).scalar()


def _answer(model: Predictor, prompts: list[str], retries: int, pause: float) -> list[str]:
    """Answers to a batch.

    After a failure the prompts still without an answer are asked again in parts half as
    large, after a pause that grows each time, so answers once given are kept.
    """
    found: dict[int, str] = {}
    size, failures = len(prompts), 0
    while open_ := [i for i in range(len(prompts)) if i not in found][:size]:
        try:
            answers = model([prompts[i] for i in open_])
        except Exception:
            failures += 1
            if failures > retries:
                raise
            size = max(1, size // 2)
            time.sleep(pause * failures)
            continue
        if len(answers) != len(open_):
            raise ValueError(f"predictor gave {len(answers)} answers to {len(open_)} prompts")
        found |= zip(open_, answers, strict=True)
    return [found[i] for i in range(len(prompts))]


def predict(
    prompt: Column,
    make_predictor: Callable[[], Predictor],
    batch_size: int = 32,
    max_retries: int = 2,
    retry_pause: float = 2.0,
) -> Column:
    """Answer of the predictor to each prompt.

    ``make_predictor`` runs once per task and returns a function from a list of
    prompts to a list of answers.  Only the prompt column goes to the Python
    worker.  A failing batch is tried again, in smaller parts, until it has failed
    more than ``max_retries`` times; then the error is raised and Spark's own task retry takes over.
    """

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_predictor()
        for prompts in series:
            texts = prompts.tolist()
            answers: list[str] = []
            for start in range(0, len(texts), batch_size):
                batch = texts[start : start + batch_size]
                answers += _answer(model, batch, max_retries, retry_pause)
            yield pd.Series(answers, dtype="object")

    return run.asNondeterministic()(prompt)


def predict_titles(
    papers: DataFrame,
    make_predictor: Callable[[], Predictor],
    instruction: str = INSTRUCTION,
    examples: Column | None = None,
    max_words: int = 15,
    **options,
) -> DataFrame:
    """Add ``predicted_title`` and ``prompt_used``; store the result before reuse."""
    prompt = title_prompt(F.col("abstract"), instruction, examples)
    answered = papers.withColumn("prompt_used", prompt).withColumn(
        "_answer", predict(F.col("prompt_used"), make_predictor, **options)
    )
    return answered.withColumn("predicted_title", clean_title(F.col("_answer"), max_words)).drop(
        "_answer"
    )


def attach_predictions(papers: DataFrame, predictions: DataFrame, on: str = "id") -> DataFrame:
    """Add predictions made elsewhere to their source rows, one row each.

    Two predictions for one key are an error, so no source row is ever multiplied.
    """
    return papers.join(one_of_each(predictions.select(on, "predicted_title"), on), on, "left")


def batched_map(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    inputs: Sequence[str],
) -> DataFrame:
    """Map Arrow batches of the input columns; only columns of ``schema`` remain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.select(*inputs).mapInPandas(run, schema)


class LeadPredictor:
    """Deterministic baseline: the first words of the abstract shown in the prompt."""

    def __init__(self, words: int = 12):
        self.words = words

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._lead(prompt) for prompt in prompts]

    def _lead(self, prompt: str) -> str:
        line = prompt.rsplit("\nAbstract: ", 1)[-1].rsplit("\nTitle:", 1)[0]
        return f'Title: {" ".join(line.split(" ")[: self.words])}'
