"""Landed works -> selected, deduplicated, normalised papers -> files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import (
    cap_and_deduplicate, filter_text, normalise_works, works_predicate,
)
from ..sources.readers import read_works
from ..sources.writers import write_collection


def collect(
    spark: SparkSession,
    path: str,
    max_results: int | None = None,
    keep_empty: bool = False,
    **selection,
) -> DataFrame:
    """Papers from landed works; ``selection`` as for ``works_predicate``.

    ``seq``, the place of a work in its files, stays: ``prepare`` wants it.
    """
    works = read_works(spark, path).filter(works_predicate(**selection))
    return normalise_works(cap_and_deduplicate(works, max_results), keep_empty, carry=["seq"])


def collect_to(
    spark: SparkSession, path: str, root: str, query: str, stamp: str,
    max_results: int | None = None, keep_empty: bool = False, **selection,
) -> str:
    papers = collect(spark, path, max_results, keep_empty, **selection).drop("seq")
    return write_collection(
        papers, root, query, stamp, filter_text(**selection), max_results, keep_empty
    )
