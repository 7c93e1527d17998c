import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from papercorpus.operators import reporting
from papercorpus.operators.cleaning import keep_first
from papercorpus.plans.collect import collect, collect_to
from papercorpus.plans.prepare import prepare
from papercorpus.sources import readers, writers
from papercorpus.sources.shared import shared_folder, spread, stored
from papercorpus.streaming import arrivals

ODD = ['say "hi", ok', "two\nlines", "back\\slash", "tab\there", "naïve ✓", "  spaced  "]
PAPERS = "id string, title string, abstract string, topics array<string>, primary_topic string"


def papers(spark):
    return spark.createDataFrame(
        [(str(i), text, text * 2, [text, "b"], None) for i, text in enumerate(ODD)], PAPERS)


def test_csv_keeps_odd_texts(spark, tmp_path):
    writers.write_csv(papers(spark), str(tmp_path / "csv"))
    got = readers.read_papers_csv(spark, str(tmp_path / "csv")).orderBy("id").collect()
    assert [r["title"] for r in got] == ODD
    assert [json.loads(r["topics"]) for r in got] == [[text, "b"] for text in ODD]
    import pandas as pd
    parts = [pd.read_csv(p, dtype=str) for p in sorted(Path(tmp_path / "csv").glob("*.csv"))]
    assert sorted(pd.concat(parts)["title"]) == sorted(ODD)


def test_papers_from_csv_to_splits(spark, tmp_path):
    """The whole preparation of CSV files, duplicates settled by their place in the files."""
    rows = [(str(i % 60), f"Title of {i % 60}", f"The abstract of paper {i % 60}, long enough to stay.",
             "AB"[i % 2], str(i)) for i in range(120)]
    raw = spark.createDataFrame(rows, "id string, title string, abstract string, primary_topic string, copy string")
    path = str(tmp_path / "in")
    ordered = raw.repartitionByRange(3, F.col("copy").cast("int")).sortWithinPartitions(F.col("copy").cast("int"))
    ordered.write.options(header=True, quoteAll=True, escape='"').csv(path)
    read = readers.read_papers_csv(spark, path)
    first = keep_first(read, ["id"]).select("copy").collect()
    assert sorted(int(r["copy"]) for r in first) == list(range(60))
    counts = {r["split"]: r["count"] for r in prepare(read).groupBy("split").count().collect()}
    assert counts == {"train": 48, "val": 6, "test": 6}


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_papers_csv(spark, str(tmp_path / "none"))


def test_json_lines_keep_nulls_and_characters(spark, tmp_path):
    writers.write_jsonl(papers(spark).coalesce(1), str(tmp_path / "json"))
    lines = next(Path(tmp_path / "json").glob("*.json")).read_text(encoding="utf-8").splitlines()
    records = [json.loads(line) for line in lines]
    assert [r["title"] for r in records] == ODD and "✓" in lines[4]
    assert all("primary_topic" in r and r["primary_topic"] is None for r in records)


def test_split_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.splits_path()
    with pytest.raises(ValueError):
        readers.splits_path("a", "b", "c")
    assert readers.splits_path(root="/out/", run="r") == "/out/runs/r/splits"
    table = papers(spark).withColumn("split", F.lit("train"))
    writers.write_splits(table, str(tmp_path / "partial"))
    with pytest.raises(FileNotFoundError):
        readers.read_splits(spark, str(tmp_path / "partial/splits"))
    names = F.array(*map(F.lit, readers.SPLITS))
    whole = table.withColumn("split", F.get(names, F.col("id").cast("int") % 3))
    writers.write_splits(whole.drop("abstract"), str(tmp_path / "slim"))
    with pytest.raises(ValueError, match="abstract"):
        readers.read_splits(spark, str(tmp_path / "slim/splits"))
    assert readers.read_splits(spark, str(tmp_path / "slim/splits"), required=()).count() == len(ODD)


WORKS = [
    {"id": "https://x.org/W1", "title": " One ", "abstract_inverted_index": {"a": [1], "b": [0]},
     "publication_year": 2020, "publication_date": "2020-05-01",
     "topics": [{"id": "https://x.org/T1", "display_name": "NLP", "score": 1}], "concepts": [], "extra": 1},
    {"id": "https://x.org/W1", "title": "again", "abstract_inverted_index": {"c": [0]},
     "publication_date": "2020-05-01", "topics": [{"id": "https://x.org/T1"}]},
    {"id": None, "title": "no id", "abstract_inverted_index": {"c": [0]},
     "publication_date": "2020-05-01", "topics": [{"id": "https://x.org/T1"}]},
    {"id": "https://x.org/W2", "title": "", "display_name": "Two", "abstract_inverted_index": None,
     "publication_date": "2020-06-01", "topics": [{"id": "https://x.org/T1", "display_name": None}]},
    {"id": "https://x.org/W3", "title": "Old", "abstract_inverted_index": {"c": [0]},
     "publication_date": "2010-01-01", "topics": [{"id": "https://x.org/T1"}]},
    {"id": "https://x.org/W4", "title": "Other topic", "abstract_inverted_index": {"c": [0]},
     "publication_date": "2020-01-01", "topics": None},
]
SELECTION = {"from_date": "2020-01-01", "topic_ids": ["T1", "T9"]}


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "works.json").write_text("\n".join(json.dumps(w) for w in WORKS))
    return str(folder)


def test_collect(spark, landed):
    got = collect(spark, landed, **SELECTION).collect()
    assert [r["seq"]["file"].rpartition("/")[2] for r in got] == ["works.json"]  # the place stays, for prepare()
    assert [{k: v for k, v in r.asDict().items() if k != "seq"} for r in got] == [{
        "id": "W1", "title": "One", "abstract": "b a", "publication_year": 2020, "topics": ["NLP"],
        "primary_topic": "NLP"}]
    kept = {r["id"]: r for r in collect(spark, landed, keep_empty=True, **SELECTION).collect()}
    assert set(kept) == {"W1", "W2"}
    assert (kept["W2"]["title"], kept["W2"]["abstract"], kept["W2"]["topics"]) == ("Two", "", [])
    # the cap comes before the duplicates go
    assert collect(spark, landed, max_results=1, **SELECTION).count() == 1
    assert {r["id"] for r in collect(spark, landed, keep_empty=True, max_results=3).collect()} == {"W1"}


def test_collection_record(spark, landed, tmp_path):
    run = collect_to(spark, landed, str(tmp_path), "Large Models", "20240101T000000Z", **SELECTION)
    assert run == "20240101T000000Z_large_models"
    record = spark.read.json(str(tmp_path / "metadata" / run)).first()
    assert record["records_saved"] == 1
    assert record["filter"] == "from_publication_date:2020-01-01,topics.id:T1|T9"
    assert record["empty_abstract_policy"] == "dropped"
    assert readers.read_papers_csv(spark, record["paths"]["processed_csv"]).count() == 1


def test_arriving_works(spark, landed, tmp_path):
    papers = arrivals.stream_papers(arrivals.stream_works(spark, landed), **SELECTION)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    arrivals.run_available(papers, out, checkpoint).awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(out).collect()] == ["W1", "W1"]
    Path(landed, "more.json").write_text(json.dumps({**WORKS[0], "id": "https://x.org/W9"}))
    arrivals.run_available(papers, out, checkpoint).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["W1", "W1", "W9"]


def test_outputs_with_missing_columns(spark):
    rows = spark.createDataFrame([("p", "val")], "predicted_title string, split string")
    sheet = writers.human_sheet(rows, "m", "zero_shot").first()
    assert (sheet["id"], sheet["abstract"], sheet["reference_title"]) == ("", "", "")
    assert writers.generated_titles(rows).columns == ["split", "predicted_title"]


def test_shared_folder_follows_the_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named
    table = stored(spark.range(3).selectExpr("id", "'a' as s"), "t")
    assert table.columns == ["id", "s"] and table.count() == 3
    assert shared_folder(spark) in table.inputFiles()[0]


def test_queries_run_from_any_folder(folder, tmp_path):
    """Python workers find the package though it lies elsewhere than the working folder."""
    root = Path(__file__).resolve().parents[1]
    code = (f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; "
            "from pyspark.sql import SparkSession; "
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
            f"print('rows', e.queries()['vocabulary_stems'](spark, {folder!r}).count())")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_spread_only_touches_small_inputs(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 8
    wide = spark.range(0, 10, 1, 20)
    assert spread(wide) is wide


def test_checkpoints(spark):
    rows = [("r1", 1, 0.5), ("r1", 2, 0.7), ("r1", 3, 0.7), ("r1", 4, None), ("r2", 9, 0.1), ("r2", 8, float("nan"))]
    df = spark.createDataFrame(rows, "run string, step int, eval_rougeL double")
    best = {r["run"]: r["step"] for r in reporting.best_checkpoint(df).collect()}
    assert best == {"r1": 2, "r2": 9}
    least = {r["run"]: r["step"] for r in reporting.best_checkpoint(df, greater_is_better=False).collect()}
    assert least == {"r1": 1, "r2": 9}
    newest = reporting.newest_checkpoints(df, 2).collect()
    assert sorted((r["run"], r["step"]) for r in newest) == [("r1", 3), ("r1", 4), ("r2", 8), ("r2", 9)]


def test_human_summary_with_a_missing_setting(spark):
    rows = [("m", "zero_shot", "fluency", 4.0), ("m", "few_shot", "fluency", 5.0), ("n", "zero_shot", "fluency", 3.0)]
    df = spark.createDataFrame(rows, "model string, setting string, criterion string, score double")
    got = {r["model"]: (r["zero_shot"], r["few_shot"], r["change"]) for r in reporting.human_summary(df).collect()}
    assert got == {"m": (4.0, 5.0, 1.0), "n": (3.0, None, None)}


def test_unreadable_work_is_an_error(spark, tmp_path):
    from papercorpus.sources.readers import read_works

    (tmp_path / "works.jsonl").write_text('{"id": "W1"}\n{"id": "W2", "ti\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_works(spark, str(tmp_path)).collect()
    assert read_works(spark, str(tmp_path), mode="DROPMALFORMED").count() == 1


def test_arrays_in_csv_splits(spark, tmp_path):
    from papercorpus.sources.readers import read_splits
    from papercorpus.sources.writers import write_splits

    rows = [("1", "t", "a", ["x", "y"], s) for s in ("train", "val", "test")]
    papers = spark.createDataFrame(rows, "id string, title string, abstract string, topics array<string>, split string")
    write_splits(papers, str(tmp_path), "csv")
    back = read_splits(spark, f"{tmp_path}/splits", "csv", multi_line=False)
    assert {r["topics"] for r in back.collect()} == {'["x","y"]'}
