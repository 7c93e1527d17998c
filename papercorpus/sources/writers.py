"""Writers.  Each is one Spark write of a DataFrame; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import slug
from ..operators.canonical import CANONICAL
from ..operators.sampling import default_key, sample_rows

HUMAN_SAMPLE = 100  # fixed value: size of the human-evaluation sample


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; null fields and non-ASCII characters are kept."""
    df.write.option("ignoreNullFields", False).json(path)


def _csv(df: DataFrame):
    """Every value quoted and written as it is, blanks at its ends included."""
    return df.write.options(
        header=True, quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def flat_fields(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, as CSV has no arrays."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in arrays})


def csv_fields(df: DataFrame) -> DataFrame:
    """The canonical columns with topics as JSON text."""
    return flat_fields(df.select([c for c in CANONICAL if c in df.columns]))


def write_csv(df: DataFrame, path: str) -> None:
    """Papers as CSV: canonical columns, every value quoted, topics as JSON."""
    _csv(csv_fields(df)).csv(path)


def write_collection(
    papers: DataFrame,
    root: str,
    query: str,
    stamp: str,
    filter_text: str = "",
    max_results: int | None = None,
    keep_empty: bool = False,
) -> str:
    """Write papers as JSON lines and CSV plus a one-row metadata record.

    The row count is observed while the JSON lines are written.  The CSV is made
    from those lines, so the papers are computed once.  Returns the run name.
    """
    spark = papers.sparkSession
    name = spark.range(1).select(slug(F.lit(query)).alias("slug")).first()["slug"]
    run = f"{stamp}_{name}"
    paths = {
        "raw_jsonl": f"{root}/raw/{run}",
        "processed_csv": f"{root}/processed/{run}",
        "metadata_json": f"{root}/metadata/{run}",
    }
    saved = Observation("saved")
    write_jsonl(papers.observe(saved, F.count(F.lit(1)).alias("records")), paths["raw_jsonl"])
    write_csv(spark.read.schema(papers.schema).json(paths["raw_jsonl"]), paths["processed_csv"])
    record = spark.range(1).select(
        F.lit(run).alias("run_name"),
        F.lit(stamp).alias("created_at_utc"),
        F.lit(query).alias("query"),
        F.lit(filter_text).alias("filter"),
        F.lit(max_results).cast("long").alias("max_results_requested"),
        F.lit(saved.get["records"]).cast("long").alias("records_saved"),
        F.lit("kept" if keep_empty else "dropped").alias("empty_abstract_policy"),
        F.struct(*[F.lit(p).alias(k) for k, p in paths.items()]).alias("paths"),
    )
    write_jsonl(record, paths["metadata_json"])
    return run


def write_by_split(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = _csv(flat_fields(df)) if fmt == "csv" else df.write
    writer.partitionBy("split").format(fmt).save(path)


def write_colocated(df: DataFrame, path: str, table: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Catalog table in buckets of ``key``, one sorted file each, and that table.

    Tables written with the same key type and number of buckets join on it without another shuffle,
    as often as they are read: splits, predictions and vectors by id. For keys that are unique or
    nearly so; a key held by many rows is one bucket. ``buckets`` should grow with the table, so
    that one bucket fits a task.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def write_splits(df: DataFrame, run_folder: str, fmt: str = "parquet") -> None:
    """Splits, and the ids of each split where there is an id."""
    write_by_split(df, f"{run_folder}/splits", fmt)
    if "id" in df.columns:
        write_by_split(df.select("split", "id"), f"{run_folder}/split_ids", fmt)


def human_sheet(predictions: DataFrame, model: str, mode: str) -> DataFrame:
    """Rows for human judges; a missing source column becomes ''."""

    def column(name: str):
        return F.col(name) if name in predictions.columns else F.lit("")

    return predictions.select(
        column("id").alias("id"),
        column("abstract").alias("abstract"),
        column("title").alias("reference_title"),
        "predicted_title",
        "split",
        F.lit(model).alias("model"),
        F.lit(mode).alias("mode"),
    )


def generated_titles(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "split", *[c for c in ("id", "predicted_title") if c in predictions.columns]
    )


def write_outputs(
    predictions: DataFrame, run_folder: str, model: str, mode: str, seed: int, fmt: str = "csv"
) -> None:
    """Predictions, generated titles, the human sheet and its seeded sample.

    ``predictions`` should be a stored table: it is read once per output, and a
    recomputed predictor could answer differently.
    """
    write_by_split(predictions, f"{run_folder}/predictions", fmt)
    write_by_split(generated_titles(predictions), f"{run_folder}/generated_titles", fmt)
    sheet = human_sheet(predictions, model, mode)
    write_by_split(sheet, f"{run_folder}/human_eval", fmt)
    sample = sample_rows(predictions, HUMAN_SAMPLE, seed, "human", default_key(predictions), by="split")
    write_by_split(human_sheet(sample, model, mode), f"{run_folder}/human_eval_sample", fmt)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric table as JSON lines."""
    write_jsonl(metrics, path)
