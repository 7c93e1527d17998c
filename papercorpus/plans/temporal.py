"""Named queries over time, streams, sketches and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection, sketches, subtotals, time_joins
from ..sources import writers
from ..sources.shared import scratch_path, stored
from ..streaming import arrivals, firsts, windows
from . import inputs
from .catalog import RUN, listed, query, rounded, six

PARTS = 4
ALL_FILES = 2**31 - 1
MONTH = 30


def streamed(rows: DataFrame, label: str) -> DataFrame:
    """What a stream has handed on when all that has landed is read."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    arrivals.run_available(rows, path, scratch_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def arriving_events(spark: SparkSession, folder: str) -> DataFrame:
    """The table of events as a file that has landed."""
    schema = inputs.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


@query
def arrivals_by_window(spark, folder):
    """Events by type in windows of six hours, those that the watermark has closed."""
    events = arriving_events(spark, folder)
    counts = windows.count_windows(events, "ts", "6 hours", "12 hours", ["event_type"], value=F.round(F.sum("value"), 2))
    return streamed(counts, "windows").select(stamp("start"), stamp("end"), "event_type", "rows", "value")


@query
def arrivals_by_sliding_window(spark, folder):
    events = arriving_events(spark, folder)
    counts = windows.count_windows(events, "ts", "2 days", "1 day", slide="1 day")
    return streamed(counts, "windows").select(stamp("start"), stamp("end"), "rows")


@query
def arrival_sessions(spark, folder):
    """Sessions of each user: events less than twelve hours apart."""
    events = arriving_events(spark, folder)
    sessions = windows.count_sessions(events, "ts", "12 hours", "1 day", ["user_id"])
    return streamed(sessions, "sessions").select(stamp("start"), stamp("end"), "user_id", "rows")


@query
def arriving_first_works(spark, folder):
    """Works that land in four parts, one after the other: the first per id, normalised.

    A part is as many files as it has tasks. It is read to its end before the next one lands, so
    the files of a part are one micro-batch whatever their number and order.
    """
    root, state, out = (scratch_path(spark, label) for label in ("landing", "papers-state", "papers"))
    landed = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 3600).alias("landed_at")
    works = stored(inputs.works(spark, folder).select("*", landed), "works")
    last = works.agg(F.max("seq")).first()[0]
    for k in range(PARTS):  # parts in order of arrival
        part = works.filter(F.floor(F.col("seq") * PARTS / (last + 1)) == k)
        writers.write_jsonl(part, f"{root}/arrived-{k}")
        stream = arrivals.stream_works(spark, f"{root}/*", files_per_trigger=ALL_FILES, extra="seq bigint, landed_at timestamp")
        first = firsts.first_arrivals(stream, "id", "landed_at", "2 days", ["seq"])
        papers = arrivals.stream_papers(first, keep_empty=True, carry=["seq"])
        arrivals.run_available(papers, out, state).awaitTermination()
    read = spark.read.schema(papers.schema).parquet(out)
    return read.select("seq", "id", "title", "abstract", listed("topics").alias("topics"), "primary_topic")


@query
def checkpoint_at_event(spark, folder):
    """Every event with its user's newest sign-up, taken as a checkpoint, not later than it."""
    events = inputs.table(spark, folder, "events")
    metrics = events.filter("event_type <> 'signup'").select("user_id", "ts", "event_id", "value")
    saved = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("step"), F.col("value").alias("saved"))
    joined = time_joins.asof_join(metrics, saved, ["user_id"], "ts", 5 * 24 * 3600, ["step"])
    return joined.select("user_id", "event_id", "step", six(F.col("value") - F.col("saved"), "change"))


def selections(spark: SparkSession, folder: str) -> DataFrame:
    """One selection of works per labelled document: dates, topics, both, or neither."""
    docs = inputs.table(spark, folder, "documents").select("doc_id", "source", "lang")
    labelled = inputs.table(spark, folder, "labels").join(docs, "doc_id")
    start = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") * 7 % 2500).cast("int"))
    end = F.date_add(start, (F.col("doc_id") % 90).cast("int"))
    return labelled.select(
        F.col("doc_id").alias("collection"),
        F.when(F.col("doc_id") % 4 < 3, start).alias("from_date"), F.when(F.col("doc_id") % 5 < 4, end).alias("to_date"),
        F.when(F.col("doc_id") % 3 > 0, F.array("source", "lang")).alias("topic_ids"),
        F.when(F.col("quality") == 1, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("concept_ids"))


@query
def collections_in_one_pass(spark, folder):
    """Works of each of many selections by date, topic and concept."""
    works = inputs.works(spark, folder).select("seq", "id", "publication_date", "topics", "concepts")
    measures = {"works": ("count", "*"), "first": ("min", "seq"), "last": ("max", "seq"), "seq_sum": ("sum", "seq")}
    return time_joins.select_collections(works, stored(selections(spark, folder), "selections"), MONTH, measures)


@query
def collect_one_selection(spark, folder):
    """The same join for one selection without dates gives what the predicate gives."""
    works = inputs.works(spark, folder).select("seq", "publication_date", "topics", "concepts")
    one = spark.range(1).select(
        F.lit("all").alias("collection"), F.lit(None).cast("date").alias("from_date"), F.lit("2024-06-30").cast("date").alias("to_date"),
        F.array(F.lit("src1"), F.lit("src2"), F.lit("fr")).alias("topic_ids"), F.array(F.lit("en"), F.lit("fr")).alias("concept_ids"))
    joined = time_joins.select_collections(works, one, MONTH).select("seq", F.lit("join").alias("by"))
    predicate = collection.works_predicate(None, "2024-06-30", ["src1", "src2", "fr"], ["en", "fr"])
    return joined.unionByName(works.filter(predicate).select("seq", F.lit("predicate").alias("by")))


@query
def diversity_from_sketches(spark, folder):
    """Exact distinct counts of runs, and whether merged sketches are within 2 %."""
    rows = inputs.scored(spark, folder).select("run", "split", "prediction")
    kept = stored(sketches.diversity_sketches(rows, RUN), "sketches")
    estimated = sketches.distinct_counts(sketches.merge_sketches(kept, ["run"]))
    finest = subtotals.diversity_by_sets(rows, [["run"]]).select(
        "run", F.expr("stack(3, 'prediction', 1 - duplicate_rate, 'distinct_1', distinct_1, 'distinct_2', distinct_2) as (measure, exact)"))
    close = F.abs(F.col("ratio") / F.col("exact") - 1) < 0.02
    return estimated.join(finest, ["run", "measure"]).select(
        "run", "measure", "total", F.round(F.col("exact") * F.col("total")).cast("long").alias("distinct"), close.alias("within_2_percent"))


SETS = [["run", "split", "lang"], ["run", "split"], ["run", "lang"], ["run"], ["lang"], []]


@query
def diversity_by_grouping_sets(spark, folder):
    """Ratios of run, split and language, and of the larger groupings, in one pass."""
    langs = inputs.table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 31 > 0, F.col("lang")).alias("lang"))
    rows = inputs.scored(spark, folder).select("doc_id", "run", "split", "prediction").join(langs, "doc_id")
    return rounded(subtotals.diversity_by_sets(rows, SETS), ["grouping", "run", "split", "lang"])
