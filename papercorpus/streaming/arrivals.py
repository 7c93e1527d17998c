"""Works that keep arriving: the row-wise collection steps as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.collection import normalise_works, with_id, works_predicate
from ..sources.readers import WORKS_SCHEMA


def stream_works(spark: SparkSession, folder: str, files_per_trigger: int = 1000, extra: str = "") -> DataFrame:
    """New JSON-lines files of raw works as they land in ``folder``; ``extra``: further columns, as DDL."""
    reader = spark.readStream.schema(", ".join(filter(None, [WORKS_SCHEMA, extra])))
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_papers(works: DataFrame, keep_empty: bool = False, carry: Sequence[str] = (), **selection) -> DataFrame:
    """Selected and normalised papers; stateless, so no watermark is needed.

    For the first work of each id put ``first_arrivals`` before it; the cap stays with the
    batch plan that reads the written table.
    """
    return normalise_works(with_id(works.filter(works_predicate(**selection))), keep_empty, carry)


def run_available(papers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has landed so far to a Parquet table, exactly once."""
    return (
        papers.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
