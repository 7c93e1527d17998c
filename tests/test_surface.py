"""SQL functions against the column expressions, table functions, landed pages, co-located tables."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from papercorpus.functions import arrays, prompts, sql, text, works
from papercorpus.sources import readers, writers

from .test_plan_shapes import plan


def pairs():
    return {
        "collapse_text(x)": text.collapse(F.col("x")), "strip_text(x)": text.strip(F.col("x")), "alnum_words(x)": text.words(F.col("x")),
        "alnum_word_count(x)": text.word_count(F.col("x")), "text_slug(x)": text.slug(F.col("x")), "first_words(x, 2)": text.first_words(F.col("x"), 2),
        "first_words(x, 0)": text.first_words(F.col("x"), 0), "clean_title(x)": text.clean_title(F.col("x")),
        "clean_title(x, 3)": text.clean_title(F.col("x"), 3), "rouge_text(x)": text.rouge_text(F.col("x")), "bleu_text(x)": text.bleu_text(F.col("x")),
        "short_id(x)": works.short_id(F.col("x")), "work_title(x, 'd ')": works.work_title(F.col("x"), F.lit("d ")),
        "seq2seq_prompt(x)": prompts.seq2seq_prompt(F.col("x")), "title_prompt(x)": prompts.title_prompt(F.col("x")),
        "title_prompt(x, ' do  it')": prompts.title_prompt(F.col("x"), " do  it"),
        "word_jaccard(alnum_words(x), alnum_words(y))": arrays.jaccard(text.words(F.col("x")), text.words(F.col("y"))),
    }


ODD = [None, "", " ", "'quoted' \"Title:\" x", "Title : a\\b\tc", "`TITLE:it's", "a/b//", "é É z", "x&quot;y 1,000 b-2-c <skipped>.", "😀 ok",
       "one two three four five six seven eight nine ten eleven twelve 13 14 15 16"]


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register(spark)


def assert_alike(spark, rows):
    df = spark.createDataFrame(rows, "x string, y string")
    for call, column in pairs().items():
        got = df.select(F.expr(call).alias("got"), column.alias("expected")).filter("not (got <=> expected)").collect()
        assert not got, (call, got)


def test_functions_on_odd_texts(spark, registered):
    assert_alike(spark, [(x, y) for x in ODD for y in (None, "one b")])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=40), st.text(alphabet="aB1 ", max_size=9)), min_size=20, max_size=40))
def test_functions_on_any_text(spark, registered, rows):
    clean = [tuple(t.encode("utf-8", "ignore").decode() for t in row) for row in rows]  # no lone surrogates
    assert_alike(spark, clean)


def test_nested_fields(spark, registered):
    schema = "t array<struct<id: string, display_name: string>>, i map<string, array<int>>, l array<int>"
    rows = [(None, None, None), ([], {}, []), ([("s/T1/", "A"), ("", None), (None, "")], {"b": [1, 4], "": [2], "a": [0, 1]}, [1, -100, None]),
            ([(None, None)], {" ": [0]}, [-100])]
    df = spark.createDataFrame(rows, schema)
    t, i = F.col("t"), F.col("i")
    for call, column in {
        "display_names(t)": works.display_names(t), "short_ids(t)": works.short_ids(t), "primary_name(t)": works.primary_name(t),
        "rebuild_abstract(i)": works.rebuild_abstract(i), "mask_labels(l, 0)": arrays.mask_labels(F.col("l"), 0),
    }.items():
        assert df.select(F.expr(call).alias("got"), column.alias("expected")).filter("not (got <=> expected)").collect() == [], call


def test_word_ngrams(spark, registered):
    got = spark.sql("select word_ngrams(array('a','b','c'), n) from values (0), (1), (2), (3), (4) as v(n) order by n").collect()
    assert [r[0] for r in got] == [[], ["a", "b", "c"], ["a b", "b c"], ["a b c"], []]


def test_functions_stay_in_the_jvm(spark, registered, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shown = plan(spark.sql("select collapse_text(text) as t, clean_title(text) from {d} where lang = 'en'", d=docs))
    assert "Python" not in shown and "EqualTo(lang,en)" in shown and "source" not in shown


def test_gram_rows(spark, registered):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"]), (3, []), (4, None)], "id int, words array<string>")
    got = spark.sql("select id, g.* from {df} as d, lateral gram_rows(d.words, 2) as g order by id, position", df=df)
    assert got.columns == ["id", "position", "gram", "word_1", "word_2"]
    assert [tuple(r) for r in got.collect()] == [(1, 0, "a b", "a", "b"), (1, 1, "b c", "b", "c")]


@pytest.mark.parametrize("call", ["gram_rows(array('a'), 0)", "gram_rows(array('a'), 'x')", "gram_rows('a', 1)", "index_rows('a')"])
def test_table_functions_refuse(spark, registered, call):
    with pytest.raises((AnalysisException, PythonException)):
        spark.sql(f"select * from {call}").collect()


def test_index_rows(spark, registered):
    df = spark.sql("select explode(array(map('b', array(2, 0), '', array(1), 'a', array(3, 0)), map(), null)) as i")
    got = spark.sql("select r.* from {df} as d, lateral index_rows(d.i) as r order by position", df=df).collect()
    assert [tuple(r) for r in got] == [(0, "a"), (2, "b"), (3, "a")]


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    for year, lines in {2009: [["W1"]], 2010: [["W2", "W3"], [], None, ["W4"]]}.items():
        folder = root / f"asked_year={year}"
        folder.mkdir()
        found = [{"meta": {"count": 3}, "results": r and [{"id": i, "title": f"t{i}", "extra": 1} for i in r]} for r in lines]
        (folder / "page.json").write_text("\n".join(map(json.dumps, found)))
    return str(root)


def test_read_work_pages(spark, pages):
    got = readers.read_work_pages(spark, pages).orderBy("seq").select("id", "title", "asked_year", "seq.item").collect()
    assert [tuple(r) for r in got] == [("W1", "tW1", 2009, 0), ("W2", "tW2", 2010, 0), ("W3", "tW3", 2010, 1), ("W4", "tW4", 2010, 0)]
    assert set(readers.read_work_pages(spark, pages, seq=None).columns) == {*readers.read_works(spark, pages, seq=None).columns}


def test_pages_outside_stay_unread(spark, pages):
    got = readers.read_work_pages(spark, pages).filter("asked_year = 2010").select("id")
    assert "PartitionFilters: [isnotnull(asked_year), (asked_year = 2010)]" in plan(got)


def test_broken_page_is_an_error(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"results": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_work_pages(spark, str(tmp_path)).collect()


def test_colocated_tables_join_without_exchange(spark, tmp_path):
    def kept(name, rows, schema):
        df = spark.createDataFrame(rows, schema)
        return writers.write_colocated(df, str(tmp_path / name), f"colocated_{name}_{tmp_path.name}", buckets=4)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        splits = kept("splits", [(str(i), "train") for i in range(50)] + [(None, "val")], "id string, split string")
        answers = kept("answers", [(str(i), f"p{i}") for i in range(0, 60, 2)], "id string, prediction string")
        vectors = kept("vectors", [(str(i), [float(i)]) for i in range(0, 50, 5)], "id string, v array<double>")
        met = splits.join(answers, "id", "left").join(vectors, "id", "left")
        assert "Exchange" not in plan(met) and plan(met).count("SortMergeJoin") == 2
        assert met.count() == 51 and met.filter("prediction is not null and v is not null").count() == 5
        assert len(list((tmp_path / "splits").glob("part-*"))) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("splits", "answers", "vectors"):
            spark.sql(f"drop table if exists colocated_{name}_{tmp_path.name}")
