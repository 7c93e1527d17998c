"""Readers.  All take declared schemas, so no inference pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

SPLITS = ("train", "val", "test")

# The nested fields of a raw work that are kept, plus its date.
WORKS_SCHEMA = """
    id string, title string, display_name string,
    abstract_inverted_index map<string, array<int>>,
    publication_year int, publication_date date,
    topics array<struct<id: string, display_name: string>>,
    concepts array<struct<id: string, display_name: string>>
"""


def file_order() -> Column:
    """Position of a text-file row: file, block, place in the block.

    A block is read by one task from top to bottom, so this orders rows as they
    stand in the files, whatever the split size.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def read_works(
    spark: SparkSession, path: str, seq: str | None = "seq", mode: str = "FAILFAST"
) -> DataFrame:
    """Raw works, one JSON object per line; unknown fields are ignored.

    A line that cannot be read is an error, unless ``mode`` says otherwise.
    """
    reader = spark.read.schema(WORKS_SCHEMA).option("mode", mode)
    works = reader.json(path)
    return works if seq is None else works.select("*", file_order().alias(seq))


def read_work_pages(
    spark: SparkSession, path: str, seq: str | None = "seq", mode: str = "FAILFAST"
) -> DataFrame:
    """Works of landed pages: one answer of a paged listing per line, its works in ``results``.

    Folders named ``column=value`` give columns; a filter on them keeps the pages of other
    folders unread, so land pages by the selection that asked for them. Works keep the order
    of their pages and their place in them. A page without results gives no works.
    """
    schema = StructType().add("results", ArrayType(StructType.fromDDL(WORKS_SCHEMA)))
    pages = spark.read.schema(schema).option("mode", mode).json(path)
    folders = [c for c in pages.columns if c != "results"]
    order = [] if seq is None else [file_order().alias("_page")]
    works = pages.select(*folders, *order, F.posexplode("results").alias("_place", "_work"))
    named = [] if seq is None else [F.struct("_page.*", F.col("_place").alias("item")).alias(seq)]
    return works.filter("_work is not null").select("_work.*", *folders, *named)


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.options(header=True, multiLine=multi_line, escape='"', enforceSchema=False)


def read_papers_csv(
    spark: SparkSession, path: str, seq: str | None = "seq", multi_line: bool = True
) -> DataFrame:
    """Paper rows as strings; a missing path is an error.

    Quoted line breaks make a CSV file unsplittable, so large inputs should come
    as many files, or with ``multi_line=False`` when no field holds a line break.
    """
    papers = _csv(spark, multi_line).csv(path)
    return papers if seq is None else papers.select("*", file_order().alias(seq))


def splits_path(path: str | None = None, root: str | None = None, run: str | None = None) -> str:
    """Folder of prepared splits: a direct path, or a run below an output root."""
    if path and run:
        raise ValueError("give either a splits path or a run name, not both")
    if path:
        return path.rstrip("/")
    if root and run:
        return f"{root.rstrip('/')}/runs/{run}/splits"
    raise ValueError("evaluation needs prepared splits: give a path or a root and a run name")


def read_splits(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    required: Sequence[str] = ("title", "abstract"),
    multi_line: bool = True,
) -> DataFrame:
    """Prepared splits as one table with a ``split`` column.

    All three splits must be there.  ``required=()`` skips the column check. CSV files
    can be read in pieces with ``multi_line=False``, if no field holds a line break.
    """
    reader = _csv(spark, multi_line) if fmt == "csv" else spark.read
    folders = [f"{path}/split={name}" for name in SPLITS]
    try:
        table = reader.format(fmt).option("basePath", path).load(folders)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"not all of {SPLITS} found below {path}") from error
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"prepared splits lack required columns: {missing}")
    return table
