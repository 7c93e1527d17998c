"""Working tables derived by Spark from the given tables.

They turn documents, conversations, embeddings, events, labels and pages into
the inputs the operators expect, with the odd cases (missing ids, blank titles,
repeated works, empty predictions) spread over all rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.shared import scratch_path, spread

SITE = "https://example.org"
PAGE = 1250
PER_CORE = 4  # tasks a core: with fewer, the last ones leave most cores idle


TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; the ones with long texts are dealt out to all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, PER_CORE) if name in TEXT_TABLES else rows


def first_line(text: str = "text") -> Column:
    return F.substring_index(text, "\n", 1)


def every(n: int, rest: int = 0) -> Column:
    return F.col("doc_id") % n == rest


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the standard layout; first line as title, whole text as abstract."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        first_line().alias("title"),
        F.col("text").alias("abstract"),
        (F.col("doc_id") % 25 + 2000).alias("publication_year"),
        F.col("source").alias("topics"),
        F.col("lang").alias("primary_topic"),
        F.col("doc_id").alias("seq"),
    )


def shared_id_papers(spark: SparkSession, folder: str, blanks: bool) -> DataFrame:
    """Papers whose id is a hash of the title, so copies share it; some ids blank."""
    shared = F.md5(F.col("title"))
    if blanks:
        shared = F.when(F.col("seq") % 10 == 3, F.lit(" ")).otherwise(shared)
    return papers(spark, folder).withColumn("id", shared)


def legacy_papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).withColumnsRenamed({"id": "openalex_id", "topics": "topic_ids"})


def capitalised_papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).select(
        F.col("title").alias("Title"),
        F.col("abstract").alias("Abstract"),
        F.col("primary_topic").alias("Category"),
        "seq",
    )


def word_index(text: Column) -> Column:
    """Word -> positions map of a text: its places sorted by word, cut where the word changes."""
    words = F.split(collapse(text), " ")
    places = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("position"))))

    def begins(e: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(e)),
                        lambda k: (k == 1) | (F.get(e, k - 1)["word"] != F.get(e, k - 2)["word"]))

    def entries(e: Column, heads: Column) -> Column:
        def entry(head: Column, j: Column) -> Column:
            size = F.coalesce(F.get(heads, j + 1), F.size(e) + 1) - head
            return F.struct(F.get(e, head - 1)["word"], F.transform(F.slice(e, head, size), lambda x: x["position"]))

        return F.map_from_entries(F.transform(heads, entry))

    # arrays of one element: each step is bound once, not written out into the next
    return F.transform(F.array(places), lambda e: F.transform(F.array(begins(e)), lambda heads: entries(e, heads))[0])[0]


def works(spark: SparkSession, folder: str, in_order: bool = False) -> DataFrame:
    """Documents as raw nested works; three in a row share an id.

    ``in_order``: dealt into ranges of ``seq`` and sorted. The plain texts are dealt, not the works:
    drawing the bounds of the ranges reads every row, and would make each index once more.
    """
    if in_order:
        read = spark.read.parquet(f"{folder}/documents.parquet")
        ranges = max(read.rdd.getNumPartitions(), PER_CORE * spark.sparkContext.defaultParallelism)
        documents = read.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    else:
        documents = table(spark, folder, "documents")
    link = F.concat(
        F.lit(f"{SITE}/works/W"),
        F.floor(F.col("doc_id") / 3).cast("string"),
        F.when(F.floor(F.col("doc_id") / 3) % 5 == 0, "/").otherwise(""),
    )

    def entry(value: Column, name: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"{SITE}/topics/"), value).alias("id"), name.alias("display_name")
        )

    named_source = F.when(~every(19), F.col("source"))
    topics = F.array(entry(F.col("source"), named_source), entry(F.col("lang"), F.col("lang")))
    return documents.select(
        F.when(every(89, 7), F.lit("")).when(~every(97, 13), link).alias("id"),
        F.when(every(13), F.lit("")).when(~every(11), first_line()).alias("title"),
        first_line().alias("display_name"),
        F.when(~every(23), word_index(F.col("text"))).alias("abstract_inverted_index"),
        (F.col("doc_id") % 25 + 2000).cast("int").alias("publication_year"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") % 2500).cast("int")).alias(
            "publication_date"
        ),
        F.when(~every(17), topics).alias("topics"),
        F.array(entry(F.col("lang"), F.col("lang"))).alias("concepts"),
        F.col("doc_id").alias("seq"),
    )


def landed_pages(spark: SparkSession, folder: str) -> str:
    """Works as answers of a paged listing, one page a line, in a folder per year asked for."""
    path = scratch_path(spark, "pages")
    rows = works(spark, folder)
    work = F.struct(*[c for c in rows.columns if c != "seq"])
    pages = rows.groupBy(F.col("publication_year").alias("asked_year"), F.floor(F.col("seq") / PAGE).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("seq", F.to_json(work).alias("work")))).alias("found"))
    results = F.array_join(F.transform("found", lambda w: w["work"]), ",")
    line = F.concat(F.lit('{"meta":{"count":'), F.size("found"), F.lit('},"results":['), results, F.lit("]}"))
    pages.select("asked_year", line.alias("value")).write.partitionBy("asked_year").text(path)
    return path


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of predictions per document: its first and its last words.

    Every 29th prediction is empty, every 7th has its ASCII letters in upper case
    (engines differ in the upper case of other letters).
    """
    words = F.split(collapse(F.col("text")), " ")
    lead = F.array_join(F.slice(F.col("words"), 1, 12), " ")
    start = F.greatest(F.size("words") - 9, F.lit(1))
    tail = F.array_join(F.slice(F.col("words"), start, F.lit(10)), " ")

    def run(name: str, prediction: Column) -> Column:
        shown = (
            F.when(every(29), F.lit(""))
            .when(every(7), F.translate(prediction, ascii_lowercase, ascii_uppercase))
            .otherwise(prediction)
        )
        return F.struct(F.lit(name).alias("run"), shown.alias("prediction"))

    return (
        table(spark, folder, "documents")
        .withColumn("words", words)
        .select(
            F.col("doc_id").cast("string").alias("id"),
            "doc_id",
            F.inline(F.array(run("lead", lead), run("tail", tail))),
            collapse(first_line()).alias("reference"),
            F.col("text").alias("abstract"),
            F.when(every(2), "val").otherwise("test").alias("split"),
        )
    )


def dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """User turns (reference) and the assistant turns that answer them (prediction)."""
    turns = table(spark, folder, "conversations")
    users = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")
    )
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("prediction")
    )
    return answers.join(users, ["conv_id", "turn"])


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a prediction vector, its successor as the reference vector."""
    vectors = table(spark, folder, "embeddings")
    following = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference_vector")
    )
    return vectors.select(
        "vec_id", F.col("embedding").alias("prediction_vector"), "label"
    ).join(following, "vec_id")


def token_matrix(vector: Column, width: int = 8) -> Column:
    """One 64-number embedding seen as eight token vectors."""
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(width))
    return F.transform(starts, lambda s: F.slice(vector, s, F.lit(width)))


def token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return vector_pairs(spark, folder).select(
        "vec_id", "label",
        F.lit("").alias("prediction"), F.lit("").alias("reference"),
        token_matrix(F.col("prediction_vector")).alias("prediction_tokens"),
        token_matrix(F.col("reference_vector")).alias("reference_tokens"),
    )


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Events as training checkpoints: user = run, event = step, value = metric."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"),
        F.col("event_id").alias("step"),
        F.col("value").alias("eval_rougeL"),
    )


def human_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as human scores: source = model, language = setting, 1 or 5 points."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang")
    setting = F.when(F.col("lang") == "en", "zero_shot").otherwise("few_shot")
    return (
        table(spark, folder, "labels")
        .join(documents, "doc_id")
        .select(F.col("source").alias("model"), setting.alias("setting"), "quality", "toxic")
        .unpivot(["model", "setting"], ["quality", "toxic"], "criterion", "flag")
        .select("model", "setting", "criterion", (F.col("flag") * 4 + 1).cast("double").alias("score"))
    )
