import pytest

from papercorpus.operators.canonical import canonicalise, detect_layout, resolve_layout
from papercorpus.operators.cleaning import (
    clean_papers, deduplicate, first_of_contents, id_gates, keep_first, with_content,
)
from papercorpus.plans.prepare import prepare, splits_or_prepare
from papercorpus.sources.writers import write_splits

LONG = "An abstract that is long enough to pass the filter, whatever its number: "


def test_layouts_are_detected_most_specific_first():
    assert detect_layout(["id", "title", "abstract"]) == "standard"
    assert detect_layout(["openalex_id", "title", "abstract"]) == "legacy_works"
    assert detect_layout(["id", "openalex_id", "title", "abstract"]) == "standard"
    assert detect_layout(["Title", "Abstract", "Category"]) == "capitalised"
    assert detect_layout(["name", "text"]) is None
    assert detect_layout(["name", "text"], title_column="name", abstract_column="text") == "standard"


def test_layout_requests():
    assert resolve_layout("auto", "standard") == "standard"
    assert resolve_layout("standard", None) == "standard"
    for requested, detected in [("other", None), ("auto", None), ("capitalised", "standard")]:
        with pytest.raises(ValueError):
            resolve_layout(requested, detected)


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="abstract"):
        canonicalise(spark.range(1).selectExpr("id", "'t' as title"), "standard")


def test_standard_papers_with_a_copy(spark):
    rows = [("A1", "Title one", LONG + "1", "NLP", 1), ("A1", "Title one", LONG + "1", "NLP", 2),
            ("A2", "Title two", LONG + "2", "CV", 3)]
    raw = spark.createDataFrame(rows, "id string, title string, abstract string, primary_topic string, seq long")
    papers = with_content(clean_papers(canonicalise(raw, carry=["seq"])))
    kept = deduplicate(papers).collect()
    assert sorted((r["id"], r["seq"]) for r in kept) == [("A1", 1), ("A2", 3)]
    assert {"id", "title", "abstract"} <= set(kept[0].asDict())


def test_legacy_papers(spark):
    rows = [("W1", "Title one", LONG + "1", 2020, "T1", "NLP"), ("W2", "Title two", LONG + "2", 2021, "T2", "CV")]
    raw = spark.createDataFrame(
        rows, "openalex_id string, title string, abstract string, publication_year int, "
        "topic_ids string, primary_topic string")
    papers = clean_papers(canonicalise(raw, "legacy_works"))
    assert [r["id"] for r in papers.orderBy("id").collect()] == ["W1", "W2"]
    assert {"topics", "primary_topic"} <= set(papers.columns)


def test_split_of_a_hundred_papers(spark):
    rows = [(f"A{i}", f"Title number {i}", f"{LONG}{i}", "AB"[i % 2], i) for i in range(100)]
    raw = spark.createDataFrame(rows, "id string, title string, abstract string, primary_topic string, seq int")
    counts = {r["split"]: r["count"] for r in prepare(raw).groupBy("split").count().collect()}
    assert counts == {"train": 80, "val": 10, "test": 10}


def test_thresholds_apply_to_collapsed_text(spark):
    rows = [("1", "a  b ", "x" * 40), ("2", "abcd", " " * 50), ("3", "abcd", "x" * 40), ("4", None, "x" * 40)]
    raw = spark.createDataFrame(rows, "id string, title string, abstract string")
    assert [r["id"] for r in clean_papers(raw).collect()] == ["3"]


PAPERS = "id string, title string, abstract string, seq int"


def ids_filled(papers):
    return [r["filled"] for r in id_gates(papers).collect()] == [True]


def test_one_blank_id_closes_the_gate(spark):
    rows = [("A", "t1", "a1", 2), ("A", "t2", "a2", 1), (" ", "t3", "a3", 3), (None, "t3", "a3", 4)]
    papers = with_content(spark.createDataFrame(rows, PAPERS))
    assert not ids_filled(papers)
    assert not ids_filled(papers.filter("id is null"))
    assert sorted(r["seq"] for r in deduplicate(papers).collect()) == [1, 2, 3]
    assert [r["seq"] for r in deduplicate(papers.filter("id = 'A'")).collect()] == [1]
    assert sorted(r["seq"] for r in first_of_contents(papers).collect()) == [1, 2, 3]
    assert deduplicate(papers.filter("seq > 9")).count() == 0


def test_each_table_has_its_own_gate(spark):
    full = [("x", "A", "t1", "a1", 1), ("x", "A", "t2", "a2", 2), ("x", "B", "t1", "a1", 3), ("x", "C", "t4", "a4", 4)]
    blank = [("y", "A", "t1", "a1", 5), ("y", "A", "t2", "a2", 6), ("y", "", "t1", "a1", 7), (None, "A", "t1", "a1", 8)]
    papers = with_content(spark.createDataFrame(full + blank, "run string, " + PAPERS))
    kept = {r["seq"]: r["row_key"] for r in deduplicate(papers, by="run").collect()}
    assert set(kept) == {1, 4, 5, 6, 8}
    assert len(set(kept.values())) == 5 and kept[1].endswith("A") and kept[5] != kept[8]


def test_a_blank_row_that_goes_still_closes_the_gate(spark):
    rows = [("A", "t1", "a1", 1), ("A", "t2", "a2", 2), ("", "t1", "a1", 3)]
    kept = deduplicate(with_content(spark.createDataFrame(rows, PAPERS))).collect()
    assert sorted(r["seq"] for r in kept) == [1, 2] and len({r["row_key"] for r in kept}) == 2


def test_gate_sees_only_rows_that_pass_the_filters(spark):
    rows = [("A", "title one", "x" * 50, 1), ("", "t", "x", 2)]
    raw = spark.createDataFrame(rows, PAPERS)
    assert ids_filled(clean_papers(raw))
    assert not ids_filled(raw)


def test_tables_are_split_on_their_own(spark):
    """One job for two tables: one stratified, one whose gate is closed by a single paper."""
    rows = [("x", f"A{i}", f"Title number {i}", f"{LONG}{i}", "AB"[i % 2], i) for i in range(100)]
    rows += [("y", f"A{i}", f"Title number {i}", f"{LONG}{i}", "C" if i else "alone", 100 + i) for i in range(40)]
    raw = spark.createDataFrame(rows, "run string, id string, title string, abstract string, primary_topic string, seq int")
    papers = prepare(raw, by="run")
    counts = {tuple(r)[:2]: r["count"] for r in papers.groupBy("run", "split").count().collect()}
    assert counts == {("x", "train"): 80, ("x", "val"): 10, ("x", "test"): 10, ("y", "train"): 32, ("y", "val"): 4, ("y", "test"): 4}
    strata = {tuple(r)[:2]: r["count"] for r in papers.filter("run = 'x'").groupBy("split", "primary_topic").count().collect()}
    assert strata["train", "A"] == strata["train", "B"] == 40 and strata["val", "A"] == 5
    alone = prepare(raw.filter("run = 'x'").drop("run"))
    assert alone.filter("split = 'train'").count() == 80


def test_prepared_splits_or_papers(spark, tmp_path):
    rows = [(f"A{i}", f"Title number {i}", f"{LONG}{i}", "AB"[i % 2], i) for i in range(20)]
    raw = spark.createDataFrame(rows, "id string, title string, abstract string, primary_topic string, seq int")
    now = splits_or_prepare(spark, raw=raw)
    assert now.count() == 20 and "split" in now.columns
    write_splits(now, f"{tmp_path}/runs/r1")
    for found in (splits_or_prepare(spark, root=str(tmp_path), run="r1", raw=raw), splits_or_prepare(spark, f"{tmp_path}/runs/r1/splits")):
        assert sorted((r["id"], r["split"]) for r in found.collect()) == sorted((r["id"], r["split"]) for r in now.collect())
    with pytest.raises(ValueError, match="not both"):
        splits_or_prepare(spark, "p", run="r", raw=raw)
    with pytest.raises(ValueError, match="needs prepared splits"):
        splits_or_prepare(spark)


def test_keep_first_is_exact_for_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 500 as string)) as k", "-id as seq", "id as v")
    kept = keep_first(df.repartition(7), ["k"]).collect()
    best = {}
    for i in range(20_000):
        best["hot" if i % 3 == 0 else str(i % 500)] = i
    assert {r["k"]: r["v"] for r in kept} == best


def test_ids_go_before_contents(spark):
    """The copy that survives by content is looked for among the first rows per id."""
    rows = [("A", "t1", "x", 1), ("A", "t2", "x", 2), ("B", "t2", "x", 3), ("C", "t2", "x", 4)]
    papers = spark.createDataFrame(rows, PAPERS)
    assert sorted(r["seq"] for r in deduplicate(with_content(papers)).collect()) == [1, 3]
    blank = papers.union(spark.createDataFrame([("", "t9", "y", 5)], PAPERS))
    assert sorted(r["seq"] for r in deduplicate(with_content(blank)).collect()) == [1, 2, 5]


def test_duplicates_may_stay(spark):
    rows = [("A", "title", LONG, 1), ("A", "title", LONG, 2), ("A", "title", LONG, 3)]
    raw = spark.createDataFrame(rows, PAPERS)
    kept = prepare(raw, remove_duplicates=False, stratify=None)
    assert sorted(r["row_key"] for r in kept.collect()) == ["1", "2", "3"]
