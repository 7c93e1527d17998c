"""ROUGE, BLEU and token-matching scores of predictions against references."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clipped_overlap, longer_ngrams, ngrams
from ..functions.stemming import lcs_length, stems_and_lcs
from ..functions.text import bleu_text, rouge_text, split_words
from ..functions.vectors import greedy_match

# Metric names, n-gram orders, and the score that marks a failure.
DEFAULT_METRICS = ("bleu", "rouge", "bertscore")
BLEU_ORDERS = (1, 2, 3, 4)
FAILED = -1.0
ROUGE = ["rouge1", "rouge2", "rougeL"]
BERTSCORE = ["bertscore_precision", "bertscore_recall", "bertscore_f1"]


def f_measure(overlap: Column, predicted: Column, expected: Column) -> Column:
    precision = overlap / F.greatest(predicted, F.lit(1))
    recall = overlap / F.greatest(expected, F.lit(1))
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(0.0)


def rouge_rows(rows: DataFrame, stem: bool = True) -> DataFrame:
    """Add rouge1, rouge2 and rougeL of each row.

    Counting happens inside the row, so nothing is shuffled.  Python workers see
    only the normalised words, for the stems and the common subsequence.
    """
    texts = {"_p": rouge_text(F.col("prediction")), "_r": rouge_text(F.col("reference"))}
    if stem:  # one Python pass: a second one would be a second worker for each task
        pairs = rows.withColumn("_s", stems_and_lcs(texts["_p"], texts["_r"]))
        known = {"_p": F.col("_s.left"), "_r": F.col("_s.right"), "_lcs": F.col("_s.lcs")}
    else:
        pairs = rows.withColumns(texts)
        known = {"_lcs": lcs_length(F.col("_p"), F.col("_r"))}
    tokens = pairs.withColumns(known).withColumns(
        {"_p1": split_words(F.col("_p")), "_r1": split_words(F.col("_r"))}
    ).withColumns({"_p2": ngrams(F.col("_p1"), 2), "_r2": ngrams(F.col("_r1"), 2)})

    def scored(shared: Column, n: int) -> Column:
        return f_measure(shared, F.size(f"_p{n}"), F.size(f"_r{n}"))

    return tokens.withColumns(
        {
            "rouge1": scored(clipped_overlap(F.col("_p1"), F.col("_r1")), 1),
            "rouge2": scored(clipped_overlap(F.col("_p2"), F.col("_r2")), 2),
            "rougeL": scored(F.col("_lcs"), 1),
        }
    ).drop("_s", "_p", "_r", "_lcs", "_p1", "_r1", "_p2", "_r2")


def bleu_counts(rows: DataFrame) -> DataFrame:
    """Add the clipped matches, the n-gram totals and both lengths of each row."""
    sides = ("prediction", "reference")
    work = rows.withColumns({f"_{s}1": split_words(bleu_text(F.col(s))) for s in sides})
    for n in BLEU_ORDERS[1:]:  # each order is made from the one before
        work = work.withColumns(
            {f"_{s}{n}": longer_ngrams(F.col(f"_{s}{n - 1}"), F.col(f"_{s}1"), n) for s in sides}
        )
    counts = {"_p_size": F.size("_prediction1"), "_r_size": F.size("_reference1")}
    for n in BLEU_ORDERS:
        counts[f"_match{n}"] = clipped_overlap(F.col(f"_prediction{n}"), F.col(f"_reference{n}"))
        counts[f"_total{n}"] = F.size(f"_prediction{n}")
    grams = [f"_{s}{n}" for s in sides for n in BLEU_ORDERS]
    return work.withColumns(counts).drop(*grams)


def bleu_score() -> Column:
    """Corpus BLEU (0 to 100) from counts summed over a group.

    Orders without a match are smoothed by halving: the k-th of them counts
    100 / (2**k * total).  No match at all, or an order no prediction is long
    enough for, gives 0.
    """
    matches = {n: F.sum(f"_match{n}") for n in BLEU_ORDERS}
    totals = {n: F.sum(f"_total{n}") for n in BLEU_ORDERS}
    p_size, r_size = F.sum("_p_size"), F.sum("_r_size")
    halvings = F.lit(0)
    logs = F.lit(0.0)
    for n in BLEU_ORDERS:
        halvings = halvings + (matches[n] == 0).cast("int")
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), halvings) * totals[n])
        precision = F.when(matches[n] == 0, smoothed).otherwise(
            F.lit(100.0) * matches[n] / totals[n]
        )
        logs = logs + F.log(precision)
    penalty = F.when(p_size >= r_size, F.lit(1.0)).otherwise(F.exp(1 - r_size / p_size))
    usable = (F.greatest(*matches.values()) > 0) & (F.least(*totals.values()) > 0)
    return F.when(usable, penalty * F.exp(logs / len(BLEU_ORDERS))).otherwise(0.0)


def bertscore_means(scored: str = "_bert") -> list[Column]:
    """Means and failure flag; a row without vectors fails its group."""
    whole = (F.count("*") > 0) & (F.count(scored) == F.count("*"))
    means = [
        F.when(whole, F.avg(f"{scored}.{part}")).otherwise(FAILED).alias(name)
        for name, part in zip(BERTSCORE, ("precision", "recall", "f1"))
    ]
    return [*means, F.when(whole, 0.0).otherwise(1.0).alias("bertscore_failed")]


def chosen_metrics(names: Iterable[str] | None) -> set[str]:
    """Metric names in lower case; the default set when none are configured."""
    return {name.lower() for name in (DEFAULT_METRICS if names is None else names)}


def text_metrics(
    rows: DataFrame,
    by: Sequence[str] = (),
    metrics: Iterable[str] | None = None,
    stem: bool = True,
    token_vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Overlap metrics, one row per group; only chosen ones enter the plan.

    Everything is counted row by row and summed in one pre-aggregated shuffle.
    ``token_vectors`` names the columns with the token vectors of prediction and
    reference; without them the token-matching scores are marked as failed.
    """
    chosen = chosen_metrics(metrics)
    needed = [*by, "prediction", "reference", *(token_vectors or ())]
    work = rows.select(*dict.fromkeys(needed))
    outputs: list[Column] = []
    if "rouge" in chosen:
        work = rouge_rows(work, stem)
        outputs += [F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in ROUGE]
    if "bleu" in chosen:
        work = bleu_counts(work)
        outputs.append(bleu_score().alias("bleu"))
    if "bertscore" in chosen and token_vectors:
        match = greedy_match(F.col(token_vectors[0]), F.col(token_vectors[1]))
        work = work.withColumn("_bert", match)
        outputs += bertscore_means()
    elif "bertscore" in chosen:
        outputs += [F.lit(FAILED).alias(name) for name in BERTSCORE]
        outputs.append(F.lit(1.0).alias("bertscore_failed"))
    if not outputs:
        raise ValueError(f"no known metric among {sorted(chosen)}")
    return work.groupBy(*by).agg(*outputs)


def _poisson_weight(uniform: Column, terms: int = 16) -> Column:
    """Poisson(1) draw from a uniform number by inverting its distribution."""
    mass, reached, thresholds = 1 / 2.718281828459045, 0.0, []
    for k in range(1, terms + 1):
        reached += mass
        thresholds.append(reached)
        mass /= k
    below = [(uniform >= F.lit(t)).cast("int") for t in thresholds]
    weight = below[0]
    for part in below[1:]:
        weight = weight + part
    return weight


def bootstrap(
    rows: DataFrame, value: str, by: Sequence[str], key: str, seed: int = 42, replicates: int = 200
) -> DataFrame:
    """Median and 95 % interval of the mean over seeded resamples.

    A row's weight in a resample is a Poisson(1) draw from a hash of seed,
    resample and key, so rows are weighted where they are: the explosion feeds a
    partial aggregate and only groups times resamples reach the shuffle.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col(key).cast("string")))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = rows.select(
        *by, value, key, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    ).withColumn("weight", _poisson_weight(uniform))
    means = drawn.groupBy(*by, "replicate").agg(
        (F.sum(F.col("weight") * F.col(value)) / F.nullif(F.sum("weight"), F.lit(0))).alias("mean")
    )
    points = {"low": 0.025, "median": 0.5, "high": 0.975}
    return means.groupBy(*by).agg(
        *[F.percentile("mean", F.lit(p)).alias(name) for name, p in points.items()]
    )
