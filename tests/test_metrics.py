import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papercorpus.functions import arrays, vectors
from papercorpus.functions.stemming import common_subsequence, stem_word
from papercorpus.operators import overlap, quality

WORDS = st.lists(st.sampled_from("abcde"), max_size=12)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


@given(WORDS, WORDS)
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == table_lcs(a, b)


def test_common_subsequence_of_long_texts():
    a = [str(i * i % 97) for i in range(600)]
    b = [str(i * 7 % 97) for i in range(500)]
    assert common_subsequence(a, b) == table_lcs(a, b)


def test_known_stems():
    pairs = {  # from the published description and its vocabulary
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
        "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
        "conditional": "condit", "rational": "ration", "digitizer": "digit", "radically": "radic",
        "differently": "differ", "analogously": "analog", "operator": "oper", "feudalism": "feudal",
        "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensitivity": "sensit",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "adoption": "adopt", "communism": "commun",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll",
        # later changes
        "dies": "die", "flies": "fli", "died": "die", "spied": "spi", "dying": "die", "enjoy": "enjoy",
        "news": "news", "succeed": "succeed", "sky": "sky", "the": "the", "geology": "geolog",
    }
    assert {w: stem_word(w) for w in pairs} == pairs


ARRAYS = "a array<string>, b array<string>"


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=60, max_size=90))
def test_overlap_both_ways(values, pairs):
    a, b = F.col("a"), F.col("b")
    got = values(pairs, ARRAYS, arrays.clipped_overlap(a, b), arrays._overlap_by_sorting(a, b),
                 arrays._overlap_by_lookup(a, b))
    for (x, y), numbers in zip(pairs, got):
        assert set(numbers) == {sum((Counter(x) & Counter(y)).values())}


def test_overlap_of_long_arrays_is_sorted(values):
    a = [str(i % 300) for i in range(2000)]
    b = [str(i % 450) for i in range(900)]
    got = values([(a, b)], ARRAYS, arrays.clipped_overlap(F.col("a"), F.col("b")))
    assert got == [sum((Counter(a) & Counter(b)).values())]


def test_ngrams_and_jaccard(values):
    got = values([(["a", "b", "c"],), (["a"],), ([],)], "a array<string>",
                 *[arrays.ngrams(F.col("a"), n) for n in (1, 2, 3, 4)])
    assert got == [(["a", "b", "c"], ["a b", "b c"], ["a b c"], []), (["a"], [], [], []), ([], [], [], [])]
    pairs = [([], []), (["a"], []), (["a", "a", "b"], ["b", "c"])]
    assert values(pairs, ARRAYS, arrays.jaccard(F.col("a"), F.col("b"))) == [1.0, 0.0, pytest.approx(1 / 3)]


ROWS = "prediction string, reference string, abstract string"


def scores(spark, rows, **options):
    df = spark.createDataFrame([(p, r, "") for p, r in rows], ROWS)
    return overlap.text_metrics(df, **options).first().asDict()


def test_rouge_by_hand(spark):
    got = scores(spark, [("the cat sat on the mat", "the cat is on the mat")], metrics=["rouge"])
    assert got["rouge1"] == pytest.approx(5 / 6)
    assert got["rouge2"] == pytest.approx(3 / 5)
    assert got["rougeL"] == pytest.approx(5 / 6)
    got = scores(spark, [("a b", "b a"), ("", "x"), ("", "")], metrics=["rouge"])
    assert got == {"rouge1": pytest.approx(1 / 3), "rouge2": 0, "rougeL": pytest.approx(1 / 6)}


def test_rouge_with_and_without_stems(spark):
    rows = [("running dogs", "run dog")]
    assert scores(spark, rows, metrics=["rouge"])["rouge1"] == 1.0
    assert scores(spark, [("jumped quickly", "jumping quick")], metrics=["rouge"])["rouge1"] == 0.5
    assert scores(spark, rows, metrics=["rouge"], stem=False)["rouge1"] == 0


def test_bleu_by_hand(spark):
    got = scores(spark, [("the cat sat on the mat", "the cat sat on a mat")], metrics=["bleu"])
    logs = [math.log(100 * m / t) for m, t in ((5, 6), (3, 5), (2, 4), (1, 3))]
    assert got["bleu"] == pytest.approx(math.exp(sum(logs) / 4))


def test_bleu_brevity_and_smoothing(spark):
    got = scores(spark, [("a b c d", "a b x y z w")], metrics=["bleu"])
    logs = [math.log(p) for p in (50, 100 / 3, 100 / (2 * 2), 100 / (4 * 1))]
    assert got["bleu"] == pytest.approx(math.exp(1 - 6 / 4) * math.exp(sum(logs) / 4))


def test_bleu_sums_over_the_corpus(spark):
    got = scores(spark, [("a b c d", "a b c d"), ("e", "f")], metrics=["bleu"])
    assert got["bleu"] == pytest.approx(100 * (4 / 5) ** 0.25)


@pytest.mark.parametrize("rows", [[("a b c d", "w x y z")], [("a b", "a b")], [("", "a")], [("", "")]])
def test_bleu_zero(spark, rows):
    assert scores(spark, rows, metrics=["bleu"])["bleu"] == 0


def test_metric_choice(spark):
    assert overlap.chosen_metrics(None) == {"bleu", "rouge", "bertscore"}
    assert set(scores(spark, [("a", "a")], metrics=["BLEU"])) == {"bleu"}
    with pytest.raises(ValueError):
        scores(spark, [("a", "a")], metrics=["other"])
    empty = spark.createDataFrame([], ROWS)
    assert overlap.text_metrics(empty, metrics=["bleu", "rouge"]).first().asDict() == {
        "bleu": 0, "rouge1": 0, "rouge2": 0, "rougeL": 0}


VECTORS = "prediction string, reference string, p array<array<float>>, r array<array<float>>"


def test_token_matching(spark):
    eye = [[1.0, 0.0], [0.0, 2.0]]
    rows = [("", "", eye, eye), ("", "", [[3.0, 0.0]], eye)]
    got = overlap.text_metrics(spark.createDataFrame(rows, VECTORS), metrics=["bertscore"],
                               token_vectors=("p", "r")).first()
    assert got["bertscore_precision"] == pytest.approx(1.0)
    assert got["bertscore_recall"] == pytest.approx((1 + 0.5) / 2)
    assert got["bertscore_f1"] == pytest.approx((1 + 2 * 0.5 / 1.5) / 2)
    assert got["bertscore_failed"] == 0
    rows.append(("", "", None, eye))
    got = overlap.text_metrics(spark.createDataFrame(rows, VECTORS), metrics=["bertscore"],
                               token_vectors=("p", "r")).first()
    assert got["bertscore_f1"] == -1 and got["bertscore_failed"] == 1


def test_token_weights(spark):
    rows = [("", "", [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])]
    weights = (F.array(F.lit(1), F.lit(0)), F.array(F.lit(1)))
    match = vectors.greedy_match(F.col("p"), F.col("r"), *weights)
    got = spark.createDataFrame(rows, VECTORS).select(match.alias("m")).first()["m"]
    assert (got["precision"], got["recall"], got["f1"]) == (1.0, 1.0, 1.0)


def test_vectors(values):
    assert values([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>",
                  vectors.l2_normalise(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0], None]
    cos = vectors.cosine(F.col("a"), F.col("b"))
    pairs = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], None)]
    assert values(pairs, "a array<float>, b array<float>", cos) == [1.0, 0.0, None]


def test_mean_pool(values):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), (None, [1])]
    got = values(rows, "v array<array<float>>, m array<int>", vectors.mean_pool(F.col("v"), F.col("m")))
    assert got == [[2.0, 3.0], [0.0, 0.0], None]


def test_scorecard_by_hand(spark):
    rows = [("Deep Nets for All", "deep nets for all", "one two three four five six seven eight"),
            (" Deep Nets for All ", "x", ""), (None, "y", "a b")]
    got = quality.quality_scorecard(spark.createDataFrame(rows, ROWS)).first().asDict()
    assert got == pytest.approx({
        "empty_rate": 1 / 3, "length_compliance_rate": 2 / 3, "duplicate_rate": 1 / 3,
        "distinct_1": 4 / 8, "distinct_2": 3 / 6, "avg_title_words": 8 / 3,
        "compression_ratio_mean": (4 / 8 + 4 + 0) / 3, "exact_match_rate": 1 / 3,
        "jaccard_title_reference_mean": 1 / 3, "semantic_cosine_mean": -1, "semantic_failed": 1})


def test_semantic_score(spark):
    rows = [("a", "b", "", [1.0, 0.0], [2.0, 0.0]), ("a", "b", "", [1.0, 0.0], [0.0, 1.0])]
    df = spark.createDataFrame(rows, ROWS + ", p array<float>, r array<float>")
    got = quality.quality_scorecard(df, vectors=("p", "r")).first()
    assert (got["semantic_cosine_mean"], got["semantic_failed"]) == (0.5, 0.0)
    broken = df.withColumn("p", F.when(F.col("r")[0] > 0, F.col("p")))
    got = quality.quality_scorecard(broken, vectors=("p", "r")).first()
    assert (got["semantic_cosine_mean"], got["semantic_failed"]) == (-1.0, 1.0)


def test_bootstrap_surrounds_the_mean(spark):
    df = spark.range(2_000).selectExpr("id", "1 as g", "cast(id % 10 as double) as v")
    got = overlap.bootstrap(df, "v", ["g"], "id", replicates=60).first()
    assert 4.2 < got["low"] < got["median"] < got["high"] < 4.8
    again = overlap.bootstrap(df.repartition(5), "v", ["g"], "id", replicates=60).first()
    assert again == got


def test_scorecard_keeps_null_groups(spark):
    from papercorpus.operators.quality import quality_scorecard

    rows = spark.createDataFrame([("a", "x y", "x y", "x"), (None, "x y", "x y", "x")],
                                 "run string, prediction string, reference string, abstract string")
    assert {r["run"] for r in quality_scorecard(rows, ["run"]).collect()} == {"a", None}
