"""Raw paper rows -> canonical, clean, deduplicated, split papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import CANONICAL, canonicalise
from ..operators.cleaning import clean_papers, deduplicate, with_content
from ..operators.sampling import split_rows
from ..sources.readers import read_splits, splits_path
from ..sources.shared import stored


def prepare(
    raw: DataFrame,
    seq: str = "seq",
    layout: str = "auto",
    min_title_chars: int = 4,
    min_abstract_chars: int = 40,
    remove_duplicates: bool = True,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    stratify: str | None = "primary_topic",
    by: str | None = None,
    **columns: str,
) -> DataFrame:
    """Canonical papers with a ``split`` column and ``row_key``.

    ``by`` names a column that tells apart several tables of papers: each is deduplicated
    and split on its own, with its own gates, all in one job.  The column stays.

    The clean papers are stored once.  Duplicates and splits are then settled on
    narrow columns of that table, and the texts are read a second time only to be
    handed on with their label.
    """
    carry = [seq] if by is None or by in CANONICAL else [seq, by]
    canonical = canonicalise(raw, layout, **columns, carry=carry)
    cleaned = clean_papers(canonical, min_title_chars, min_abstract_chars)
    papers = stored(with_content(cleaned), "papers")
    if remove_duplicates:
        papers = deduplicate(papers, seq, by)
    else:
        papers = papers.withColumn("row_key", F.col(seq).cast("string"))
    papers = papers.drop(seq, "content")
    return split_rows(papers, train, val, test, seed, F.col("row_key"), stratify, by)


def splits_or_prepare(
    spark: SparkSession, path: str | None = None, root: str | None = None, run: str | None = None,
    fmt: str = "parquet", raw: DataFrame | None = None, **options,
) -> DataFrame:
    """Prepared splits where a path or a run names some, or else ``raw`` papers cleaned and split now.

    Naming none and giving no papers is an error, as is naming both a path and a run.
    ``options`` as for ``prepare``.
    """
    if path or run or raw is None:
        return read_splits(spark, splits_path(path, root, run), fmt)
    return prepare(raw, **options)
