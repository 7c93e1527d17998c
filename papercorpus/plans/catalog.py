"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text, vectors
from ..functions import works as work_text
from ..functions.prompts import mode_label, seq2seq_prompt, title_prompt
from ..functions.stemming import stem_text
from ..operators import cleaning, collection, overlap, quality, reporting, sampling, scoring
from ..operators.canonical import canonical_columns, canonicalise
from ..operators.ngrams import count_ngrams
from ..sources import readers, writers
from ..sources.shared import scratch_path, ship_package, stored
from . import inputs
from .collect import collect, collect_to
from .evaluate import evaluate, predict_splits
from .prepare import prepare, splits_or_prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42
STAMP = "20240101T000000Z"
RUN = ["run", "split"]


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def six(value: Column, name: str) -> Column:
    return F.round(value.cast("double"), 6).alias(name)


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[six(F.col(c), c) for c in df.columns if c not in keys])


def listed(column: str | Column) -> Column:
    return F.array_join(column, "|")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "documents")


# --- sources -----------------------------------------------------------------


def landed_works(spark: SparkSession, folder: str) -> str:
    """Derived works written as JSON lines in document order; returns their folder."""
    path = scratch_path(spark, "works")
    writers.write_jsonl(inputs.works(spark, folder, in_order=True), path)
    return path


@query
def works_read_json(spark, folder):
    works = readers.read_works(spark, landed_works(spark, folder), seq=None)
    return works.select(
        "id", "title", "display_name",
        F.col("publication_year").cast("long").alias("publication_year"),
        F.col("publication_date").cast("string").alias("publication_date"),
        F.size("abstract_inverted_index").cast("long").alias("index_words"),
        listed(F.transform("topics", lambda t: t["id"])).alias("topic_urls"),
    )


@query
def works_filter(spark, folder):
    predicate = collection.works_predicate(
        "2019-03-01", "2024-06-30", ["src1", "src2", "fr"], ["en", "fr"]
    )
    works = inputs.works(spark, folder).filter(predicate)
    return works.select("seq", "id", F.col("publication_date").cast("string").alias("publication_date"))


@query
def works_cap_deduplicate(spark, folder):
    works = inputs.works(spark, folder).select("id", "display_name", "seq")
    return collection.cap_and_deduplicate(works, 600)


@query
def works_keep_first(spark, folder):
    works = inputs.works(spark, folder).select("id", "display_name", "seq")
    return collection.cap_and_deduplicate(works)


@query
def works_with_id(spark, folder):
    return collection.with_id(inputs.works(spark, folder)).select("id", "seq")


@query
def papers_read_csv(spark, folder):
    path = scratch_path(spark, "papers-csv")
    writers.write_csv(inputs.papers(spark, folder), path)
    return readers.read_papers_csv(spark, path, seq=None)


@query
def papers_read_csv_in_order(spark, folder):
    """The first paper per title in file order, files being written in id order."""
    path = scratch_path(spark, "papers-csv")
    ordered = inputs.papers(spark, folder).repartitionByRange("seq").sortWithinPartitions("seq")
    writers.write_csv(ordered, path)
    return cleaning.keep_first(readers.read_papers_csv(spark, path), ["title"]).select("id", "title")


@query
def splits_read_prepared(spark, folder):
    root = scratch_path(spark, "outputs")
    papers = sampling.split_rows(cleaned(spark, folder), seed=SEED)
    writers.write_splits(papers, f"{root}/runs/base")
    splits = readers.read_splits(spark, readers.splits_path(root=root, run="base"))
    return splits.groupBy("split", "primary_topic").agg(F.count("*").alias("rows"))


@query
def splits_read_csv(spark, folder):
    run = scratch_path(spark, "run")
    papers = sampling.split_rows(cleaned(spark, folder), seed=SEED)
    writers.write_splits(papers, run, fmt="csv")
    splits = readers.read_splits(spark, readers.splits_path(f"{run}/splits"), "csv", required=())
    return splits.select("id", "title", "split")


# --- layouts and projections --------------------------------------------------


@query
def canonical_standard(spark, folder):
    named = inputs.papers(spark, folder).withColumnsRenamed({"id": "key", "title": "heading"})
    return canonicalise(named, "standard", id_column="key", title_column="heading")


@query
def canonical_without_id(spark, folder):
    return canonicalise(inputs.papers(spark, folder).drop("id", "topics"), "standard")


@query
def canonical_legacy(spark, folder):
    return canonicalise(inputs.legacy_papers(spark, folder), "legacy_works")


@query
def canonical_capitalised(spark, folder):
    return canonicalise(inputs.capitalised_papers(spark, folder), "capitalised")


@query
def canonical_detected(spark, folder):
    """All three layouts found from their column names."""
    tables = {
        "standard": inputs.papers(spark, folder),
        "legacy_works": inputs.legacy_papers(spark, folder),
        "capitalised": inputs.capitalised_papers(spark, folder),
    }
    parts = [
        canonicalise(raw).select(F.lit(name).alias("layout"), "id", "title", "primary_topic")
        for name, raw in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def canonical_keep_columns(spark, folder):
    return canonical_columns(inputs.papers(spark, folder))


@query
def works_normalise(spark, folder):
    papers = collection.normalise_works(inputs.works(spark, folder), True, carry=["seq"])
    return papers.withColumns(
        {"topics": listed("topics"), "publication_year": F.col("publication_year").cast("long")}
    )


@query
def works_drop_empty_abstract(spark, folder):
    papers = collection.normalise_works(inputs.works(spark, folder), carry=["seq"])
    return papers.select("seq", "id", "abstract")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Unstored prediction rows of both runs, as written by an evaluation; the id names the run."""
    return inputs.scored(spark, folder).select(
        F.concat_ws("-", "run", "id").alias("id"), "abstract", F.col("reference").alias("title"),
        F.col("prediction").alias("predicted_title"), "split",
    )


@query
def human_eval_sheet(spark, folder):
    return writers.human_sheet(predictions(spark, folder).drop("abstract"), "lead", "zero_shot")


@query
def generated_titles(spark, folder):
    return writers.generated_titles(predictions(spark, folder))


@query
def attach_predictions(spark, folder):
    known = predictions(spark, folder)
    papers = inputs.papers(spark, folder).select(F.concat(F.lit("lead-"), "id").alias("id"), "title")
    return scoring.attach_predictions(papers, known)


# --- cleaning and duplicates --------------------------------------------------


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_papers(inputs.papers(spark, folder))


@query
def papers_clean(spark, folder):
    return cleaned(spark, folder)


@query
def papers_clean_strict(spark, folder):
    papers = cleaning.clean_papers(inputs.papers(spark, folder), 60, 1500)
    return papers.select("id", F.length("title").cast("long").alias("title_chars"),
                         F.length("abstract").cast("long").alias("abstract_chars"))


def deduplicated(papers: DataFrame) -> DataFrame:
    marked = stored(cleaning.with_content(cleaning.clean_papers(papers)), "papers")
    return cleaning.deduplicate(marked).select("id", "title", "abstract", "seq")


@query
def deduplicate_by_id(spark, folder):
    return deduplicated(inputs.shared_id_papers(spark, folder, blanks=False))


@query
def deduplicate_gate_closed(spark, folder):
    return deduplicated(inputs.shared_id_papers(spark, folder, blanks=True))


@query
def deduplicate_by_content(spark, folder):
    papers = stored(cleaning.with_content(cleaned(spark, folder)), "papers")
    return cleaning.first_of_contents(papers).drop("content")


@query
def prepare_papers(spark, folder):
    """The whole preparation: canonical, clean, first copies, exact stratified split."""
    return prepare(inputs.papers(spark, folder), seed=SEED)


@query
def prepare_split_counts(spark, folder):
    papers = prepare(inputs.papers(spark, folder), seed=SEED)
    return papers.groupBy("split", "primary_topic").agg(F.count("*").alias("rows"))


@query
def prepare_two_tables(spark, folder):
    """Two tables of papers in one job: one has all its ids, the other blanks, so its gate is closed.

    The strata of the second one include single papers, so it is not stratified either.
    """
    full = inputs.shared_id_papers(spark, folder, blanks=False).withColumn("collection", F.lit("full"))
    blank = inputs.shared_id_papers(spark, folder, blanks=True).withColumn("collection", F.lit("blank"))
    alone = F.when(F.col("seq") % 50 == 0, F.col("seq").cast("string")).otherwise(F.col("primary_topic"))
    both = full.unionByName(blank.withColumn("primary_topic", alone)).withColumn("seq", F.struct("collection", "seq"))
    papers = prepare(both, seed=SEED, by="collection")
    return papers.select("collection", F.sha2("row_key", 256).alias("key_sha256"), "title", "primary_topic", "split")


@query
def splits_prepare_now(spark, folder):
    """No prepared splits are named, so the papers are cleaned and split on the spot."""
    papers = splits_or_prepare(spark, raw=inputs.papers(spark, folder), seed=SEED, stratify="topics")
    return papers.select("id", "split")


@query
def collect_then_prepare(spark, folder):
    """Landed works, selected and normalised, then cleaned, deduplicated and split."""
    papers = collect(spark, landed_works(spark, folder), from_date="2019-03-01", concept_ids=["en", "fr", "de"])
    return prepare(papers, seed=SEED).select("id", "title", "primary_topic", "split")


@query
def prepare_blank_ids(spark, folder):
    """No ids at all: duplicates by content only, split ordered by content."""
    papers = prepare(inputs.capitalised_papers(spark, folder), seed=SEED)
    return papers.select("row_key", "title", "split")


# --- splits and samples -------------------------------------------------------


@query
def stratum_counts(spark, folder):
    papers = inputs.papers(spark, folder)
    named = papers.withColumn("primary_topic", F.when(F.col("seq") % 6 > 0, F.col("primary_topic")))
    return sampling.stratum_counts(named, "primary_topic")


@query
def stratify_gate(spark, folder):
    papers = inputs.papers(spark, folder).withColumn("size", F.length("title"))
    gates = [
        sampling.stratify_gate(sampling.stratum_counts(papers, column)).select(
            F.lit(column).alias("stratum_column"), "*"
        )
        for column in ("primary_topic", "topics", "size")
    ]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


@query
def stratum_quotas(spark, folder):
    """Proportional quotas with many tied remainders."""
    rows = documents(spark, folder).withColumn("residue", F.col("doc_id") % 37)
    strata = sampling.stratum_counts(rows, "residue")
    draws = int(0.83 * strata.agg(F.sum("size").alias("n")).first()["n"])
    return sampling.stratum_quotas(strata, draws, SEED)


@query
def split_train_rest(spark, folder):
    papers = inputs.papers(spark, folder).select("id", "primary_topic")
    cut = sampling.fraction_cut(papers, 0.8, SEED, "train", F.col("id"), "primary_topic")
    return sampling.label_cut(papers, cut, "train")


@query
def split_stratified(spark, folder):
    papers = inputs.papers(spark, folder).select("id", "topics")
    return sampling.split_rows(papers, 0.7, 0.1, 0.2, SEED, stratify="topics")


@query
def split_unstratified(spark, folder):
    papers = inputs.papers(spark, folder).select("id", "title")
    return sampling.split_rows(papers, seed=SEED, stratify=None).select("id", "split")


@query
def split_gate_closed(spark, folder):
    """Title lengths include single rows, so the stratification gate stays shut."""
    papers = inputs.papers(spark, folder).select("id", F.length("title").alias("size"))
    return sampling.split_rows(papers, seed=SEED, stratify="size").select("id", "split")


@query
def split_sizes(spark, folder):
    papers = inputs.papers(spark, folder).select("id", "primary_topic")
    return sampling.split_sizes(sampling.split_rows(papers, seed=SEED))


@query
def few_shot_examples(spark, folder):
    train = inputs.papers(spark, folder)
    shots = scoring.few_shot_examples(train, 4, SEED, F.col("id"))
    return shots.withColumn("number", F.col("number").cast("long"))


@query
def evaluation_sample(spark, folder):
    rows = inputs.scored(spark, folder).select(F.concat_ws("-", "run", "id").alias("id"), "split")
    return sampling.evaluation_cap(rows, 400, SEED, F.col("id"))


@query
def evaluation_sample_by_cut(spark, folder):
    """A sample too large for a top-k, taken by cut points."""
    lines = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("split")
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return sampling.evaluation_cap(lines, 12_000, SEED, key)


@query
def human_eval_sample(spark, folder):
    sheet = writers.human_sheet(predictions(spark, folder), "lead", "zero_shot")
    sample = sampling.sample_rows(sheet, writers.HUMAN_SAMPLE, SEED, "human", F.col("id"), "split")
    return sample.drop("abstract")


# --- scalar functions ---------------------------------------------------------


@query
def text_collapse(spark, folder):
    return documents(spark, folder).select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


@query
def text_strip(spark, folder):
    padded = F.concat(F.lit("\t  "), F.col("text"), F.lit(" \n"))
    return documents(spark, folder).select("doc_id", text.strip(padded).alias("stripped"))


@query
def abstract_rebuild(spark, folder):
    index = documents(spark, folder).select("doc_id", inputs.word_index(F.col("text")).alias("index"))
    return index.select("doc_id", work_text.rebuild_abstract(F.col("index")).alias("abstract"))


@query
def url_last_segment(spark, folder):
    pages = inputs.table(spark, folder, "pages")
    slashed = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    url = F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(slashed)
    return pages.select("page_id", work_text.short_id(url).alias("segment"))


@query
def topic_fields(spark, folder):
    return inputs.works(spark, folder).select(
        "seq",
        listed(work_text.display_names(F.col("topics"))).alias("topic_names"),
        listed(work_text.short_ids(F.col("topics"))).alias("topic_ids"),
        listed(work_text.display_names(F.col("concepts"))).alias("concept_names"),
        work_text.primary_name(F.col("topics")).alias("primary_topic"),
    )


@query
def topics_as_json(spark, folder):
    pairs = documents(spark, folder).select("doc_id", F.array("source", "lang").alias("topics"))
    return pairs.withColumn("topics", F.to_json("topics"))


@query
def text_slug(spark, folder):
    pages = inputs.table(spark, folder, "pages")
    lines = documents(spark, folder).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("key"), text.slug(inputs.first_line()).alias("slug")
    )
    return pages.select(
        F.concat(F.lit("p"), F.col("page_id")).alias("key"), text.slug(F.col("url")).alias("slug")
    ).unionByName(lines)


@query
def text_words(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.word_count(F.col("text")).cast("long").alias("word_count"),
        F.md5(F.array_join(text.words(F.col("text")), " ")).alias("words_md5"),
    )


@query
def text_ngrams(spark, folder):
    return count_ngrams(spark.read.parquet(f"{folder}/documents.parquet"), "text")


@query
def title_jaccard(spark, folder):
    rows = inputs.scored(spark, folder)
    score = arrays.jaccard(F.col("p"), F.col("r"))
    words = rows.select("id", "run", text.words(F.col("prediction")).alias("p"),
                        text.words(F.col("reference")).alias("r"))
    return words.select("id", "run", six(score, "jaccard"))


def raw_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts dressed up like model answers: prefixes, quotes, several lines."""
    dressed = F.concat(
        F.when(inputs.every(2), '"').otherwise(" "),
        F.when(inputs.every(3), "Title : ").when(inputs.every(5), "TITLE:'").otherwise("`"),
        F.col("text"),
        F.when(inputs.every(4), "\"'").otherwise("\n"),
    )
    return documents(spark, folder).select("doc_id", dressed.alias("raw"))


@query
def title_postprocess(spark, folder):
    return raw_answers(spark, folder).select(
        "doc_id",
        text.clean_title(F.col("raw")).alias("title"),
        F.md5(text.clean_title(F.col("raw"), 0)).alias("uncut_md5"),
    )


@query
def first_words(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.first_words(text.collapse(F.col("text")), 7).alias("lead")
    )


@query
def few_shot_prefix(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.md5(F.substring("text", 1, scoring.FEW_SHOT_CHARS)).alias("prefix_md5")
    )


@query
def vocabulary_stems(spark, folder):
    """Every distinct word of all texts and its stem."""
    words = F.explode(text.split_words(text.rouge_text(F.col("text"))))
    vocabulary = documents(spark, folder).select(words.alias("word")).distinct()
    return vocabulary.select("word", stem_text(F.col("word")).alias("stem"))


@query
def vector_normalise(spark, folder):
    scaled = F.transform("embedding", lambda x: x * (F.col("vec_id") + 1).cast("float"))
    unit = inputs.table(spark, folder, "embeddings").select(
        "vec_id", vectors.l2_normalise(scaled).alias("unit")
    )
    return unit.select("vec_id", F.posexplode("unit").alias("place", "value")).select(
        "vec_id", F.col("place").cast("long").alias("place"), six(F.col("value"), "value")
    )


@query
def vector_mean_pool(spark, folder):
    """Eight token vectors per embedding, the tokens masked by id."""
    mask = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.when(F.col("vec_id") % 50 == 0, 0)
        .otherwise(((F.col("vec_id") + i) % 3 > 0).cast("int")),
    )
    pooled = inputs.table(spark, folder, "embeddings").select(
        "vec_id",
        vectors.mean_pool(inputs.token_matrix(F.col("embedding")), mask).alias("pooled"),
    )
    return pooled.select("vec_id", F.posexplode("pooled").alias("place", "value")).select(
        "vec_id", F.col("place").cast("long").alias("place"), six(F.col("value"), "value")
    )


@query
def mask_label_ids(spark, folder):
    """Word lengths as label ids, short words ignored (-100), padded with 0."""
    ids = F.transform(
        text.words(F.col("text")),
        lambda w: F.when(F.length(w) < 3, -100).otherwise(F.length(w)),
    )
    return documents(spark, folder).select(
        "doc_id", F.md5(listed(arrays.mask_labels(ids, pad=0).cast("array<string>"))).alias("label_ids_md5")
    )


# --- prompts and scoring ------------------------------------------------------


@query
def prompt_seq2seq(spark, folder):
    return documents(spark, folder).select("doc_id", seq2seq_prompt(F.col("text")).alias("prompt"))


@query
def prompt_zero_shot(spark, folder):
    prompt = title_prompt(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", prompt.alias("prompt"), F.lit(mode_label(0)).alias("mode")
    )


@query
def prompt_few_shot(spark, folder):
    papers = inputs.papers(spark, folder)
    examples = scoring.few_shot_examples(papers, 4, SEED, F.col("id"))
    prompt = title_prompt(F.col("abstract"), examples=scoring.example_block(examples))
    return papers.select(
        "id", prompt.alias("prompt"), F.lit(mode_label(4)).alias("mode")
    )


@query
def predict_titles(spark, folder):
    papers = cleaned(spark, folder).select("id", "abstract")
    predicted = scoring.predict_titles(papers, scoring.LeadPredictor)
    return predicted.select("id", "predicted_title", F.md5("prompt_used").alias("prompt_md5"))


@query
def predict_fixed_batches(spark, folder):
    """Seq2seq prompts in batches of four, output only collapsed."""
    first = partial(scoring.LeadPredictor, 5)
    answers = documents(spark, folder).select(
        "doc_id",
        scoring.predict(F.concat(F.lit("\nAbstract: "), F.col("text")), first, batch_size=4).alias("raw"),
    )
    return answers.select("doc_id", text.collapse(F.col("raw")).alias("predicted_title"))


@query
def batched_map_columns(spark, folder):
    """A batch function replacing all columns by two model-input columns."""

    def encode(batch: pd.DataFrame) -> pd.DataFrame:
        words = batch["title"].str.split(" ")
        return pd.DataFrame({
            "input_chars": batch["abstract"].str.len(),
            "labels": words.map(lambda w: "|".join(str(len(x)) for x in w)),
        })

    rows = cleaned(spark, folder)
    return scoring.batched_map(rows, encode, "input_chars long, labels string", ["title", "abstract"])


# --- quality metrics ----------------------------------------------------------


@query
def quality_scorecard(spark, folder):
    return rounded(quality.quality_scorecard(inputs.scored(spark, folder), RUN), RUN)


@query
def quality_scorecard_overall(spark, folder):
    return rounded(quality.quality_scorecard(inputs.scored(spark, folder)), [])


@query
def quality_scorecard_empty(spark, folder):
    none = inputs.scored(spark, folder).filter("run = 'missing'")
    return rounded(quality.quality_scorecard(none), [])


@query
def quality_row_means(spark, folder):
    means = quality.row_metrics(inputs.scored(spark, folder), RUN, 4, 15, None)
    return rounded(means.select(*RUN, *quality.ROW_METRICS), RUN)


@query
def quality_duplicates_and_diversity(spark, folder):
    return rounded(quality.corpus_metrics(inputs.scored(spark, folder), ["run"]), ["run"])


@query
def quality_dialogues(spark, folder):
    rows = inputs.dialogues(spark, folder).withColumn("abstract", F.col("reference"))
    return rounded(quality.quality_scorecard(rows), [])


@query
def semantic_cosine(spark, folder):
    pairs = inputs.vector_pairs(spark, folder).withColumn(
        "score", vectors.cosine(F.col("prediction_vector"), F.col("reference_vector"))
    )
    means = pairs.groupBy("label").agg(*quality.semantic_metrics(F.col("score")))
    return rounded(means, ["label"])


@query
def semantic_missing_vectors(spark, folder):
    """Vectors joined by id; the groups that lack one are marked as failed."""
    base = inputs.table(spark, folder, "embeddings")
    supplied = base.filter("label <> 1 or vec_id % 9 > 0").select(
        "vec_id", F.col("embedding").alias("v")
    )
    rows = quality.attach_vectors(base.select("vec_id", "label"), supplied, "vec_id")
    score = vectors.cosine(F.col("v"), F.col("v"))
    return rounded(rows.groupBy("label").agg(*quality.semantic_metrics(score)), ["label"])


# --- overlap metrics ----------------------------------------------------------


def rouge_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[six(F.col(name), name) for name in overlap.ROUGE])


@query
def rouge_rows_plain(spark, folder):
    rows = inputs.scored(spark, folder).select("id", "run", "prediction", "reference")
    return rouge_columns(overlap.rouge_rows(rows, stem=False), ["id", "run"])


@query
def rouge_rows_stemmed(spark, folder):
    rows = inputs.scored(spark, folder).select("id", "run", "prediction", "reference")
    return rouge_columns(overlap.rouge_rows(rows), ["id", "run"])


@query
def rouge_by_run(spark, folder):
    rows = inputs.scored(spark, folder)
    return rounded(overlap.text_metrics(rows, RUN, ["ROUGE"]), RUN)


@query
def rouge_dialogues(spark, folder):
    """Long texts on both sides."""
    rows = overlap.rouge_rows(inputs.dialogues(spark, folder), stem=False)
    return rouge_columns(rows, ["conv_id", "turn"])


@query
def rouge_bootstrap(spark, folder):
    rows = overlap.rouge_rows(
        inputs.scored(spark, folder).select("id", "run", "prediction", "reference"), stem=False
    )
    return rounded(overlap.bootstrap(rows, "rouge1", ["run"], "id", SEED, 40), ["run"])


@query
def bleu_by_run(spark, folder):
    return rounded(overlap.text_metrics(inputs.scored(spark, folder), RUN, ["bleu"]), RUN)


@query
def bleu_dialogues(spark, folder):
    return rounded(overlap.text_metrics(inputs.dialogues(spark, folder), [], ["bleu"]), [])


@query
def bleu_no_match(spark, folder):
    """Predictions turned round share no longer n-grams: smoothing and zeros."""
    rows = inputs.scored(spark, folder).withColumn("prediction", F.reverse("prediction"))
    rows = rows.withColumn("group", F.col("doc_id") % 40)
    return rounded(overlap.text_metrics(rows, ["run", "group"], ["bleu"]), ["run", "group"])


@query
def token_matching(spark, folder):
    rows = inputs.token_pairs(spark, folder)
    pairs = ("prediction_tokens", "reference_tokens")
    return rounded(overlap.text_metrics(rows, ["label"], ["bertscore"], token_vectors=pairs), ["label"])


@query
def token_matching_missing(spark, folder):
    """No vectors supplied: the scores are marked as failed."""
    rows = inputs.scored(spark, folder)
    return rounded(overlap.text_metrics(rows, ["run"], ["bleu", "BERTScore"]), ["run"])


@query
def checkpoint_metrics(spark, folder):
    """BLEU and ROUGE per checkpoint, eight checkpoints per run."""
    rows = inputs.scored(spark, folder).withColumn("step", F.col("doc_id") % 8)
    keys = ["run", "step"]
    return rounded(overlap.text_metrics(rows, keys, ["bleu", "rouge"], stem=False), keys)


@query
def scorecard_by_split(spark, folder):
    """Text and quality metrics of both splits as one long table."""
    rows = predictions(spark, folder)
    long = evaluate(rows, ["split"], ["bleu", "rouge"], stem=False)
    return rounded(long, ["split", "family", "metric"])


@query
def evaluate_end_to_end(spark, folder):
    """Prepared papers, few-shot prompts, predictions, metrics."""
    papers = stored(prepare(inputs.papers(spark, folder), seed=SEED), "prepared")
    predicted = predict_splits(papers, scoring.LeadPredictor, num_shots=4, seed=SEED)
    long = evaluate(predicted, ["split", "mode"], ["bleu", "rouge"])
    return rounded(long, ["split", "mode", "family", "metric"])


# --- reports ------------------------------------------------------------------


@query
def best_checkpoint(spark, folder):
    return reporting.best_checkpoint(inputs.checkpoints(spark, folder))


@query
def worst_checkpoint(spark, folder):
    return reporting.best_checkpoint(inputs.checkpoints(spark, folder), greater_is_better=False)


@query
def newest_checkpoints(spark, folder):
    return reporting.newest_checkpoints(inputs.checkpoints(spark, folder), keep=2)


@query
def metric_long_table(spark, folder):
    wide = quality.row_metrics(inputs.scored(spark, folder), RUN, 4, 15, None)
    long = reporting.metric_long_table(wide, RUN, "quality", quality.ROW_METRICS)
    return rounded(long, [*RUN, "family", "metric"])


@query
def tradeoff_table(spark, folder):
    """ROUGE-1 of the document runs and token matching of the embedding labels."""
    rouge = overlap.text_metrics(inputs.scored(spark, folder), RUN, ["rouge"], stem=False)
    named = rouge.select(F.col("run").alias("model"), F.col("split").alias("paradigm"), "rouge1")
    tokens = inputs.token_pairs(spark, folder).select(
        F.when(F.col("vec_id") % 2 == 0, "lead").otherwise("tail").alias("model"),
        F.when(F.col("label") % 2 == 0, "val").otherwise("test").alias("paradigm"),
        "prediction", "reference", "prediction_tokens", "reference_tokens",
    )
    keys = ["model", "paradigm"]
    matched = overlap.text_metrics(
        tokens, keys, ["bertscore"], token_vectors=("prediction_tokens", "reference_tokens")
    )
    long = reporting.metric_long_table(named, keys, "text").unionByName(
        reporting.metric_long_table(matched, keys, "text", ["bertscore_f1"])
    )
    return reporting.tradeoff_table(long)


@query
def human_summary(spark, folder):
    return rounded(
        reporting.human_summary(inputs.human_scores(spark, folder)), ["model", "criterion"]
    )


@query
def dataset_sizes(spark, folder):
    papers = inputs.papers(spark, folder).select("id", "topics")
    return reporting.size_rows(sampling.split_rows(papers, seed=SEED, stratify="topics"))


# --- sinks --------------------------------------------------------------------


@query
def works_jsonl_round_trip(spark, folder):
    path = scratch_path(spark, "jsonl")
    papers = collection.normalise_works(inputs.works(spark, folder), True)
    writers.write_jsonl(papers, path)
    read = spark.read.schema(papers.schema).json(path)
    return read.withColumns(
        {"topics": listed("topics"), "publication_year": F.col("publication_year").cast("long")}
    )


@query
def works_csv_round_trip(spark, folder):
    path = scratch_path(spark, "csv")
    writers.write_csv(collection.normalise_works(inputs.works(spark, folder)), path)
    read = readers.read_papers_csv(spark, path, seq=None)
    return read.withColumn("topics", listed(F.from_json("topics", "array<string>")))


@query
def collect_papers(spark, folder):
    """Landed JSON lines, predicate, first per id, normalised."""
    papers = collect(
        spark, landed_works(spark, folder), max_results=None,
        from_date="2019-03-01", topic_ids=["src1", "src2", "src3", "en"],
    )
    return papers.groupBy("primary_topic").agg(F.count("*").alias("papers"))


@query
def collection_record(spark, folder):
    root = scratch_path(spark, "collection")
    run = collect_to(
        spark, landed_works(spark, folder), root, "Natural  Language\tProcessing!", STAMP,
        max_results=None, concept_ids=["en", "fr"],
    )
    record = spark.read.json(f"{root}/metadata/{run}")
    return record.select("run_name", "query", "filter", "records_saved", "empty_abstract_policy")


@query
def split_files_round_trip(spark, folder):
    run = scratch_path(spark, "run")
    papers = sampling.split_rows(cleaned(spark, folder).drop("seq"), seed=SEED)
    writers.write_splits(papers, run, fmt="csv")
    return spark.read.options(header=True).csv(f"{run}/split_ids").select("id", "split")


def written_outputs(spark: SparkSession, folder: str) -> str:
    run = scratch_path(spark, "run")
    kept = stored(predictions(spark, folder), "predictions")
    writers.write_outputs(kept, run, "lead", mode_label(0), SEED, fmt="parquet")
    return run


@query
def predictions_round_trip(spark, folder):
    read = spark.read.parquet(f"{written_outputs(spark, folder)}/predictions")
    return read.select("id", "title", "predicted_title", "split")


@query
def evaluation_outputs_round_trip(spark, folder):
    """Rows of each written output, its split, and a sum over their ids."""
    run = written_outputs(spark, folder)
    parts = [
        spark.read.parquet(f"{run}/{name}").select(F.lit(name).alias("output"), "id", "split")
        for name in ("generated_titles", "human_eval", "human_eval_sample")
    ]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("output", "split")
        .agg(F.count("*").alias("rows"), F.sum(F.substring_index("id", "-", -1).cast("long")).alias("id_sum"))
    )


@query
def few_shot_round_trip(spark, folder):
    path = scratch_path(spark, "shots")
    train = inputs.papers(spark, folder)
    shots = scoring.few_shot_examples(train, 6, SEED, F.col("id"))
    writers.write_jsonl(shots, path)
    read = spark.read.schema(shots.schema).json(path)
    return read.select(
        F.col("number").cast("long").alias("number"), "title", F.md5("abstract").alias("abstract_md5")
    )


@query
def metrics_round_trip(spark, folder):
    path = scratch_path(spark, "metrics")
    wide = quality.corpus_metrics(inputs.scored(spark, folder), ["run"])
    long = reporting.metric_long_table(wide, ["run"], "quality")
    writers.write_metrics(long, path)
    return rounded(spark.read.schema(long.schema).json(path), ["run", "family", "metric"])
