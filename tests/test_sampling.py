import math
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papercorpus.operators.collection import first_rows
from papercorpus.operators import sampling

from .test_plan_shapes import plan


def quotas(spark, sizes, draws):
    strata = spark.createDataFrame(list(sizes.items()), "stratum string, size long")
    rows = sampling.stratum_quotas(strata, draws, 42).collect()
    assert {r["stratum"]: r["size"] for r in rows} == sizes
    return {r["stratum"]: r["quota"] for r in rows}


def test_quotas_by_hand(spark):
    # shares 2.8, 2.1, 2.1: floors 2, 2, 2; the one left goes to the remainder .8
    assert quotas(spark, {"a": 4, "b": 3, "c": 3}, 7) == {"a": 3, "b": 2, "c": 2}
    assert quotas(spark, {"a": 10, "b": 10}, 20) == {"a": 10, "b": 10}
    assert quotas(spark, {"a": 10, "b": 10}, 0) == {"a": 0, "b": 0}


def test_tied_remainders_are_shared_out_exactly(spark):
    got = quotas(spark, {f"s{i:02}": 3 for i in range(40)}, 50)
    assert sum(got.values()) == 50 and set(got.values()) == {1, 2}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.floats(0, 1))
def test_quotas_are_largest_remainders(spark, sizes, share):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    total = sum(sizes)
    draws = math.floor(share * total)
    got = quotas(spark, named, draws)
    assert sum(got.values()) == draws
    remainders = {s: Fraction(n * draws, total) - n * draws // total for s, n in named.items()}
    for s, n in named.items():
        assert got[s] - n * draws // total in (0, 1)
    raised = [remainders[s] for s in named if got[s] > named[s] * draws // total]
    others = [remainders[s] for s in named if got[s] == named[s] * draws // total]
    assert not raised or not others or min(raised) >= max(others)


def ranked(spark, rows, n, salt):
    df = spark.createDataFrame([(str(i),) for i in rows], "id string")
    order = sampling.seeded_order(42, salt, F.col("id"))
    return {r["id"] for r in df.orderBy(order).limit(n).collect()}


def test_unstratified_split_equals_the_full_sort(spark):
    df = spark.range(997).selectExpr("cast(id as string) as id")
    got = sampling.split_rows(df, 0.8, 0.1, 0.1, stratify=None).collect()
    train = {r["id"] for r in got if r["split"] == "train"}
    assert train == ranked(spark, range(997), 797, "train")
    rest = [i for i in range(997) if str(i) not in train]
    assert {r["id"] for r in got if r["split"] == "val"} == ranked(spark, rest, 100, "val")
    assert len(got) == 997


def skewed(spark):
    return spark.range(3_000).selectExpr(
        "cast(id as string) as id",
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 11 as string) end as topic")


def split_map(df, **options):
    rows = sampling.split_rows(df, stratify="topic", **options).collect()
    return {r["id"]: (r["topic"], r["split"]) for r in rows}


def test_split_does_not_depend_on_partitioning(spark):
    df = skewed(spark)
    assert split_map(df.repartition(1)) == split_map(df.repartition(13, "id"))
    assert split_map(df, seed=1) != split_map(df, seed=2)


def test_stratified_split_is_whole_and_exact(spark):
    got = split_map(skewed(spark))
    assert len(got) == 3_000
    assert Counter(s for _, s in got.values()) == {"train": 2400, "val": 300, "test": 300}
    sizes = Counter(t for t, _ in got.values())
    train = Counter(t for t, s in got.values() if s == "train")
    assert all(abs(train[t] - 0.8 * n) < 1 for t, n in sizes.items())


def test_gate(spark):
    def gate(*counts):
        strata = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "stratum string, size long")
        return sampling.stratify_gate(strata).first()["stratify"]

    assert gate(2, 5) is True
    assert gate(1, 5) is False  # a single row cannot be split
    assert gate(7) is False  # one stratum


def test_gate_opens_again_for_the_rest(spark):
    """One stratum of a single row shuts the gate; once that row is in train it opens."""
    order = sampling.seeded_order(42, "train", F.col("id"))
    ids = [r["id"] for r in spark.range(100).selectExpr("cast(id as string) as id").orderBy(order).collect()]
    rows = [(ids[0], "single")] + [(i, "AB"[n % 2]) for n, i in enumerate(ids[1:])]
    got = split_map(spark.createDataFrame(rows, "id string, topic string"))
    assert got[ids[0]][1] == "train"
    rest = Counter(v for v in got.values() if v[1] != "train")
    assert sum(rest.values()) == 20 and Counter(s for _, s in rest.elements()) == {"val": 10, "test": 10}
    assert abs(rest[("A", "val")] - rest[("A", "test")]) <= 1


def test_tiny_and_empty_tables(spark):
    empty = spark.range(0).selectExpr("cast(id as string) as id", "'a' as topic")
    assert sampling.split_rows(empty, stratify="topic").count() == 0
    one = spark.range(1).selectExpr("cast(id as string) as id", "'a' as topic")
    assert sampling.split_rows(one, stratify="topic").first()["split"] == "test"


def test_fractions_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        sampling.split_rows(spark.range(1), 0.7, 0.2, 0.2)


def test_sample_by_cut_point_equals_top_k(spark):
    df = skewed(spark)
    order = sampling.seeded_order(7, "x", F.col("id"))
    everything = [(r["id"], r["topic"]) for r in df.orderBy(order).collect()]
    by_topic = Counter()
    expected = [by_topic.update([t]) or (i, t) for i, t in everything if by_topic[t] < 50]
    for by, rows in ((None, everything[:50]), ("topic", expected)):
        got = sampling.sample_rows(df, 50, 7, "x", F.col("id"), by).collect()
        assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert sampling.sample_rows(df, 9_999, 7, "x", F.col("id")).count() == 3_000
    assert sampling.sample_rows(df, 0, 7, "x", F.col("id")).count() == 0


def test_keys_must_be_there_and_unique(spark):
    blank = spark.range(200).selectExpr("'' as id", "'a' as split", "cast(id as string) as row_key")
    assert sampling.sample_rows(blank, 5, 1, "x", sampling.default_key(blank), "split").count() == 5
    assert Counter(r["split"] for r in sampling.split_rows(blank, stratify=None).collect()) == {
        "train": 160, "val": 20, "test": 20}
    with pytest.raises(Exception, match="not unique"):
        sampling.sample_rows(blank, 5, 1, "x", F.col("id"), "split").count()
    with pytest.raises(Exception, match="null key"):
        sampling.split_rows(blank.selectExpr("nullif(id, '') as id"), stratify=None).count()
    with pytest.raises(ValueError, match="unique key"):
        sampling.default_key(blank.select("split"))


def test_evaluation_cap_of_zero_keeps_all(spark):
    df = skewed(spark).withColumn("split", F.lit("val"))
    assert sampling.evaluation_cap(df, 0, 1, F.col("id")) is df
    assert sampling.evaluation_cap(df, 10, 1, F.col("id")).count() == 10


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_first_rows_by_cut_point(spark, n):
    rows = spark.range(500).selectExpr("(id * 7919) % 500 as seq", "id as v").repartition(7)
    assert sorted(r["seq"] for r in first_rows(rows, n).collect()) == list(range(min(n, 500)))
    nested = rows.select(F.struct(F.lit("f").alias("file"), "seq").alias("seq"), "v")
    assert first_rows(nested, n).count() == min(n, 500)
    shown = plan(first_rows(rows, n))
    assert "TakeOrdered" not in shown and "GlobalLimit" not in shown.replace("LocalLimit", "") or n == 0
