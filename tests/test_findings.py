"""Cases that larger tables brought up."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papercorpus.llm import line_dedup
from papercorpus.operators import ngrams, overlap, sampling, time_joins
from papercorpus.plans import catalog, inputs, temporal
from papercorpus.sources import writers
from papercorpus.sources.shared import spread

from .test_plan_shapes import plan


@pytest.mark.parametrize("n", range(1, 13))
def test_equal_rows_may_tie_at_a_cut(spark, n):
    rows = [("a", 1, "x")] * 5 + [("b", 2, "x")] * 4 + [("c", None, "x")] * 3 + [("a", 1, "y")] * 2 + [("d", 4, "y")]
    df = spark.createDataFrame(rows, "id string, v int, split string").repartition(3)
    got = sampling.evaluation_cap(df, n, 42, F.col("id")).collect()
    order = sampling.seeded_order(42, "eval", F.col("id"))
    expected = []
    for split in "xy":
        expected += df.filter(F.col("split") == split).orderBy(order).limit(n).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, expected))


def test_different_rows_may_not_tie_at_a_cut(spark):
    df = spark.createDataFrame([("a", n % 2) for n in range(6)], "id string, v int")
    with pytest.raises(Exception, match="not unique"):
        sampling.sample_rows(df, 3, 1, "x", F.col("id")).count()
    assert sampling.sample_rows(df, 6, 1, "x", F.col("id")).count() == 6


@pytest.fixture
def paths(monkeypatch, tmp_path):
    """Scratch folders below the test's own, by label."""
    def scratch(spark, label):
        return str(tmp_path / label)

    for module in (catalog, temporal, inputs):
        monkeypatch.setattr(module, "scratch_path", scratch)
    return tmp_path


def test_arriving_parts_are_many_files(spark, folder, paths):
    assert temporal.arriving_first_works(spark, folder).count() > 0
    for k in range(4):
        assert len(list((paths / "landing" / f"arrived-{k}").glob("part-*"))) > 1


def test_csv_in_order_is_as_many_files_as_there_are_ranges(spark, folder, paths):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        catalog.papers_read_csv_in_order(spark, folder)
    finally:
        spark.conf.unset(name)
    assert len(list((paths / "papers-csv").glob("part-*"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_landed_works_are_dealt_before_their_indexes_are_made(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(writers, "write_jsonl", lambda df, path: written.append(df))
    catalog.landed_works(spark, folder)
    shown = plan(written[0])
    assert shown.count("rangepartitioning") == 1 and shown.index("map_from_entries") < shown.index("rangepartitioning")
    assert "map_from_entries" not in shown[shown.index("rangepartitioning"):]


def test_spread_deals_few_tasks_a_core(spark):
    some = spark.range(0, 10, 1, 20)
    assert spread(some, 4).rdd.getNumPartitions() == 32 and spread(some) is some


def test_text_tables_are_several_tasks_a_core(spark, folder):
    assert inputs.table(spark, folder, "documents").rdd.getNumPartitions() == 32


def test_measures_of_selections_equal_those_of_the_pairs(spark):
    rng = random.Random(8)
    day = lambda: rng.choice([None, *(date(2019, 12, 20) + timedelta(days=d) for d in range(0, 700, 5))])
    ids = lambda: rng.choice([None, [], ["x"], ["x", "y", "x"], ["z", None], [None]])
    named = lambda: rng.choice([None, [], [(f"https://s/{t}",) for t in rng.choice(["x", "y", "xy", "zxx"])], [(None,)]])
    works = spark.createDataFrame([(rng.choice([None, n]), day(), named(), named()) for n in range(300)],
                                  "seq long, publication_date date, topics array<struct<id:string>>, concepts array<struct<id:string>>")
    asked = [(rng.choice([None, n]), day(), day(), ids(), ids()) for n in range(200)]
    asked += asked[:9] + [(900, None, None, None, None), (901, date(1990, 1, 1), date(2050, 1, 1), [], ["x"])]
    selections = spark.createDataFrame(asked, "collection int, from_date date, to_date date, topic_ids array<string>, concept_ids array<string>")
    measures = {"n": ("count", "*"), "known": ("count", "seq"), "low": ("min", "seq"), "high": ("max", "seq"), "total": ("sum", "seq")}
    for some in (works, works.filter("publication_date is null"), works.limit(0)):
        pairs = time_joins.select_collections(some, selections)
        expected = pairs.groupBy("collection").agg(F.count("*").alias("n"), F.count("seq").alias("known"), F.min("seq").alias("low"),
                                                   F.max("seq").alias("high"), F.sum("seq").alias("total"))
        got = time_joins.select_collections(some, selections, measures=measures)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected.collect()))


def test_table_functions_hold_no_large_batches(spark, folder):
    shown = plan(catalog.QUERIES["sql_word_pairs"](spark, folder))
    assert "BatchEvalPythonUDTF" in shown and "ArrowEvalPythonUDTF" not in shown
    assert "Python" not in plan(catalog.QUERIES["sql_index_words"](spark, folder))


def test_stems_and_subsequences_are_one_python_pass(spark):
    rows = spark.createDataFrame([("Dogs running", "the dog runs"), (None, ""), ("", "x")], "prediction string, reference string")
    scored = overlap.rouge_rows(rows)
    assert plan(scored).count("ArrowEvalPython ") == 1 and scored.columns == ["prediction", "reference", *overlap.ROUGE]
    assert [round(r["rougeL"], 6) for r in scored.collect()] == [0.8, 0, 0]


def test_line_dedup_plans_alike_at_any_size(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\ne")], "doc_id long, text string")
    clean = line_dedup.dedup_lines(docs)
    assert "Broadcast" not in plan(clean)
    assert sorted(map(tuple, clean.select("doc_id", "text").collect())) == [(1, "a b\nc d"), (2, "e")]


ODD_TEXTS = [None, "", "...", "one", "one two", "One TWO three", "a b c d", "a b c d e a b c d", "x", "y", "İstanbul K ẞ naïve 1st",
             "the " * 30, "a,b;c\td\u00a0e", "of of of of the", "w" * 50 + " v", *[f"copy {k % 3} of one line" for k in range(20)]]


def grams_of(texts, longest):
    found = Counter()
    for value in texts:
        words = re.findall("[A-Za-z0-9]+", value or "")
        for n in range(1, longest + 1):
            found.update((n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return found


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_ngrams_of_odd_texts(spark, longest):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string").repartition(5)
    got = ngrams.count_ngrams(df, "text", longest)
    lowered = [r[0] for r in df.select(F.lower("text")).collect()]
    assert got.dtypes == [("n", "int"), ("gram", "string"), ("seen", "bigint")]
    rows = got.collect()
    assert {(r.n, r.gram): r.seen for r in rows} == grams_of(lowered, longest) and len(rows) == len(grams_of(lowered, longest))
    assert ngrams.count_ngrams(df.limit(0), "text", longest).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 22])
def test_ngrams_are_the_same_however_words_are_cut(monkeypatch, size):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", size)
    texts = [t.lower() if t else "" for t in ODD_TEXTS]
    column = pa.array(["cut off", *texts])[1:]
    parts = ngrams._counted(4)(iter([pa.record_batch({"text": column})]))
    got = {(r["n"], r["gram"]): r["seen"] for b in ngrams._added(4)(parts) for r in b.to_pylist()}
    assert got == grams_of(texts, 4)


def test_ngrams_shuffle_no_row_for_a_threefold_of_words_and_repeats_once():
    words = " ".join(f"w{k}" for k in range(100))
    batches = [*ngrams._counted(4)(iter([pa.record_batch({"text": [words] * 50})]))]
    assert sum(b.num_rows for b in batches) == 97 + 1 + 99 + 100


def test_ngram_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([("word " * 100,)] * 80, "text string")
    monkeypatch.setattr(ngrams, "TASK_BYTES", 1000)
    assert ngrams.count_ngrams(df, "text").rdd.getNumPartitions() == 40


def made_up_texts(rows, words, seed=5):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0189", k=rng.randint(2, 9))) for _ in range(3000)]
    return [" ".join(known[int(len(known) * rng.random() ** 3)] for _ in range(words)) for _ in range(rows)]


def shuffled_bytes(df):
    """Bytes that all exchanges of the plan that ran have written."""

    def within(node):
        while node.nodeName().startswith(("AdaptiveSparkPlan", "ShuffleQueryStage", "ResultQueryStage")):
            node = node.executedPlan() if node.nodeName().startswith("Adaptive") else node.plan()
        written = node.metrics().get("shuffleBytesWritten")
        own = written.get().value() if node.nodeName() == "Exchange" and written.isDefined() else 0
        return own + sum(within(node.children().apply(k)) for k in range(node.children().size()))

    df.collect()
    return within(df._jdf.queryExecution().executedPlan())


def test_ngrams_are_shuffled_in_a_few_times_the_bytes_of_the_texts(spark):
    texts = made_up_texts(160, 2000)
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(4)
    moved = shuffled_bytes(ngrams.count_ngrams(df, "text"))
    assert 0 < moved < 3 * sum(map(len, texts))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_ngrams_are_the_same_however_they_are_dealt(spark, monkeypatch, longest):
    texts = [*ODD_TEXTS, *made_up_texts(5, 300), *["of the same words again"] * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lowered = [r[0] for r in df.select(F.lower("text")).collect()]
    monkeypatch.setattr(ngrams, "TASK_BYTES", 150)
    got = ngrams.count_ngrams(df, "text", longest)
    assert got.rdd.getNumPartitions() > 50
    rows = got.collect()
    assert {(r.n, r.gram): r.seen for r in rows} == grams_of(lowered, longest) and len(rows) == len(grams_of(lowered, longest))


def test_ngram_ranges_keep_first_words_together_and_are_even(spark):
    texts = made_up_texts(50, 400)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    bounds = ngrams._bounds(df, "text", 3, sum(map(len, texts)), 20)
    assert 15 <= len(bounds) <= 19 and bounds == sorted(set(bounds)) and max(b.count(" ") for b in bounds) <= 2
    counted = ngrams._counted(4)(iter([pa.record_batch({"text": texts})]))
    rows = [r for b in ngrams._packed(bounds)(counted) for r in b.to_pylist()]
    sizes, homes = Counter(), {}
    for r in rows:
        sizes[r["part"]] += r["grams"]
        for b in ngrams._unpacked(iter([pa.RecordBatch.from_pylist([r])])):
            for gram in b["gram"].to_pylist():
                if r["n"] >= 3:
                    assert homes.setdefault(" ".join(gram.split(" ")[:3]), r["part"]) == r["part"]
    assert max(sizes.values()) < 3 * sum(sizes.values()) / 20


def test_ngram_ranges_of_texts_without_words(spark):
    df = spark.createDataFrame([("...",), (None,), ("",)], "text string")
    assert ngrams._bounds(df, "text", 3, 3, 20) == []
    assert ngrams.count_ngrams(df, "text").collect() == []
