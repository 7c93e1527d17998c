"""Named queries over SQL text, landed pages and co-located tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import sql
from ..sources import readers, writers
from ..sources.shared import scratch_path
from . import inputs
from .catalog import documents, query

BUCKETS = 16


@query
def sql_text_rules(spark, folder):
    sql.register(spark)
    return spark.sql(
        """
        select doc_id, md5(collapse_text(text)) as collapsed_md5, md5(strip_text(text)) as stripped_md5,
               text_slug(substring_index(text, '\\n', 1)) as slug, clean_title(text) as title,
               first_words(collapse_text(text), 7) as lead, alnum_word_count(text) as words,
               md5(rouge_text(text)) as rouge_md5, md5(bleu_text(text)) as bleu_md5, title_prompt(text) as prompt
        from {documents}""", documents=documents(spark, folder))


@query
def sql_title_overlap(spark, folder):
    """Shared words of title and prediction, and the pairs of words in a prediction."""
    sql.register(spark)
    return spark.sql(
        """
        select id, run, round(word_jaccard(alnum_words(prediction), alnum_words(reference)), 6) as jaccard,
               array_join(word_ngrams(alnum_words(prediction), 2), '|') as pairs
        from {scored}""", scored=inputs.scored(spark, folder))


@query
def sql_work_fields(spark, folder):
    sql.register(spark)
    return spark.sql(
        """
        select seq, array_join(display_names(topics), '|') as topic_names, array_join(short_ids(topics), '|') as topic_ids,
               array_join(display_names(concepts), '|') as concept_names, primary_name(topics) as primary_topic
        from {works}""", works=inputs.works(spark, folder))


@query
def sql_abstract_rebuild(spark, folder):
    sql.register(spark)
    index = documents(spark, folder).select("doc_id", inputs.word_index(F.col("text")).alias("index"))
    return spark.sql("select doc_id, rebuild_abstract(index) as abstract from {works}", works=index)


@query
def sql_word_pairs(spark, folder):
    """Counts of word pairs, by the table function in a lateral join."""
    sql.register(spark)
    return spark.sql(
        """
        select word_1, word_2, count(*) as seen
        from (select alnum_words(text) as words from {documents}) as d, lateral gram_rows(d.words, 2) as g
        group by word_1, word_2""",
        documents=documents(spark, folder))


@query
def sql_index_words(spark, folder):
    """Places of each word of the inverted indexes, by the table function in a lateral join."""
    sql.register(spark)
    index = documents(spark, folder).select(inputs.word_index(F.col("text")).alias("index"))
    return spark.sql(
        """
        select word, count(*) as places, sum(position) as position_sum
        from {works} as d, lateral index_rows(d.index) as r group by word""", works=index)


@query
def works_read_pages(spark, folder):
    """Works from 2010 on; pages of earlier years stay unread."""
    works = readers.read_work_pages(spark, inputs.landed_pages(spark, folder)).filter("asked_year >= 2010")
    return works.select("id", "title", "publication_year", "asked_year", F.size("topics").alias("topics"), F.col("seq.item").alias("item"))


@query
def splits_colocated(spark, folder):
    """Predictions and vectors met with their splits, all three kept in buckets of the id."""
    def kept(df, name):
        table = f"papercorpus_{name}_{uuid4().hex}"
        return writers.write_colocated(df, scratch_path(spark, name), table, buckets=BUCKETS)

    scored = inputs.scored(spark, folder)
    splits = kept(scored.filter("run = 'lead'").select("id", "split", "reference"), "splits")
    predictions = kept(scored.select("id", "run", "prediction"), "predictions")
    vectors = inputs.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    met = splits.join(predictions, "id").join(kept(vectors, "vectors"), "id", "left")
    return met.groupBy("split", "run").agg(
        F.count("*").alias("rows"), F.count("label").alias("vectors"), F.sum("label").alias("labels"),
        F.sum(F.length("prediction")).alias("chars"), F.count_if(F.col("prediction") == F.col("reference")).alias("same"))
