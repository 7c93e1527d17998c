"""One query for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship_package
from . import (
    chat, context_mixing, fingerprints, hard_negatives, line_dedup, mixing, near_duplicates, nearest, oracles, packing, periodic_runs,
    personal_data, quality_rules, sharding,
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under the mixed model."""
    return context_mixing.score_texts(documents(spark, folder))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document by extendible hashing, 1 MiB of text at most in each."""
    return sharding.shard(documents(spark, folder), limit=1 << 20)


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data.find_personal_data(documents(spark, folder).select("doc_id", "text"))
    counts = [F.col(f"personal.n_{k}").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("personal.base", 256).alias("base_sha256"),
                        F.col("personal.spans").alias("spans"), F.col("personal.n_added").alias("n_added"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    judged = quality_rules.judge(documents(spark, folder).select("doc_id", "text"))
    q = [F.col(f"quality.{c}").alias(c) for c in
         [*quality_rules.COUNTS[:5], "base_failed", "kept", "dup_line_chars", *quality_rules.COVERS]]
    return judged.select("doc_id", *q)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.pack(documents(spark, folder))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as formatted, read back from the output."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat.format_chats(turns).withColumn("turns", chat.read_back(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.edited_fingerprints(documents(spark, folder))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document over links of 85 % of 3-word shingles."""
    return near_duplicates.near_duplicates(documents(spark, folder), shingle=3, percent=85)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line resembles."""
    return line_dedup.dedup_lines(documents(spark, folder)).select("doc_id", "text", "n_lines", "n_removed")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    rows = hard_negatives.whole_numbers(spark.read.parquet(f"{folder}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    rows = nearest.usable_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return nearest.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every document, some tails made periodic first."""
    docs = documents(spark, folder).select("doc_id", "text")
    ship_package(spark)
    found = docs.select("doc_id", periodic_runs.periodic_runs(periodic_runs.repeat_tails("doc_id", "text")).alias("periodic"))
    runs_ = F.col("periodic.runs")
    line = F.transform(runs_, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size(runs_) > 0, "\n").otherwise(""))
    top = F.array_max(F.transform(runs_, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return found.select("doc_id", F.size(runs_).cast("long").alias("n_runs"), top.alias("top"), listed.alias("listed"),
                        F.col("periodic.collapsed").alias("collapsed")).select(
        "doc_id", "n_runs", (-F.col("top.col2")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.col3")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.col3")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_context_mixing, op2_sharding, op3_personal_data, op4_quality_rules, op5_best_fit_packing, op6_chat_formatting, op7_fingerprints, op8_mixing, op9_near_duplicates, op10_line_dedup,
    op11_hard_negatives, op12_nearest_neighbours, op13_periodic_runs, pipeline)}

#: Name -> SQL of the same result; where SQL cannot express a query, tests compare it with brute force.
ORACLES: dict[str, str] = oracles.ORACLES
