"""Joins by time, streams with late rows and restarts, sketches and subtotals."""

from __future__ import annotations

import json
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papercorpus.operators import sketches, subtotals, time_joins
from papercorpus.operators.collection import works_predicate
from papercorpus.streaming import arrivals, firsts, windows

from .test_plan_shapes import plan

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


# --- as-of join -----------------------------------------------------------------


def as_of(left, right):
    out = []
    for run, t, n in left:
        known = [r for r in right if None not in (run, t) and r[0] == run and r[1] is not None and r[1] <= t]
        out.append((run, t, n, max(known, key=lambda r: (r[1], r[2]))[2] if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [60, 3600, 10**6])
def test_asof_join_equals_brute_force(spark, bucket):
    rng = random.Random(bucket)
    run = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(run(), rng.choice([None, *range(0, 900, 3)]), n) for n in range(300)] + [("alone", 5, 1000), ("hot", -50, 1001)]
    right = [(run(), rng.choice([None, *range(0, 900, 5)]), step) for step in range(80)] + [("hot", 30, 500), ("hot", 30, 501)]
    schema = "run string, t timestamp, {} int"
    l = spark.createDataFrame([(r, at(t), n) for r, t, n in left], schema.format("n"))
    r = spark.createDataFrame([(r, at(t), n) for r, t, n in right], schema.format("step"))
    got = time_joins.asof_join(l, r, ["run"], "t", bucket, ["step"])
    assert got.columns == ["run", "t", "n", "step"]
    minutes = lambda t: None if t is None else int((t - START).total_seconds() // 60)
    assert sorted(((x["run"], minutes(x["t"]), x["n"], x["step"]) for x in got.collect()), key=str) == as_of(left, right)


def test_asof_join_splits_a_hot_run(spark):
    rows = spark.range(100).select(F.lit("hot").alias("run"), F.timestamp_seconds("id").alias("t"), "id")
    other = rows.withColumnRenamed("id", "step")
    shown = plan(time_joins.asof_join(rows, other, ["run"], "t", 10))
    assert "hashpartitioning(run, _bucket" in shown and "Join" not in shown
    assert "partial_max" in shown  # what is carried over is made in each task first


def test_asof_join_of_nothing_and_clashes(spark):
    rows = spark.createDataFrame([("a", at(1), 1)], "run string, t timestamp, n int")
    none = spark.createDataFrame([], "run string, t timestamp, step int")
    assert [tuple(r)[2:] for r in time_joins.asof_join(rows, none, ["run"], "t", 60).collect()] == [(1, None)]
    assert time_joins.asof_join(none, rows, ["run"], "t", 60).count() == 0
    with pytest.raises(ValueError, match="n"):
        time_joins.asof_join(rows, rows, ["run"], "t", 60)


# --- many selections ------------------------------------------------------------

WORKS = "seq int, publication_date date, topics array<struct<id:string>>, concepts array<struct<id:string>>"
SELECTIONS = "collection int, from_date date, to_date date, topic_ids array<string>, concept_ids array<string>"


def test_selections_equal_the_predicate(spark):
    rng = random.Random(4)
    day = lambda: rng.choice([None, *(date(2020, 1, 1) + timedelta(days=d) for d in range(0, 300, 7))])
    ids = lambda: rng.choice([None, [], ["x"], ["x", "y"], ["z"]])
    named = lambda: rng.choice([None, [], [(f"https://s/{t}",) for t in rng.choice(["x", "y", "xy", "zw"])]])
    works = spark.createDataFrame([(n, day(), named(), named()) for n in range(120)], WORKS)
    asked = [(n, day(), day(), ids(), ids()) for n in range(40)]
    got = time_joins.select_collections(works, spark.createDataFrame(asked, SELECTIONS), days=20)
    assert got.columns == ["collection", *works.columns]
    found = {}
    for r in got.collect():
        found.setdefault(r["collection"], []).append(r["seq"])
    for n, start, end, topics, concepts in asked:
        expected = works.filter(works_predicate(start, end, topics or (), concepts or ())).select("seq")
        assert sorted(found.get(n, [])) == sorted(r["seq"] for r in expected.collect())


def test_selections_meet_in_bins(spark):
    works = spark.createDataFrame([], WORKS)
    asked = spark.createDataFrame([], SELECTIONS)
    joined = time_joins.select_collections(works, asked)
    assert joined.count() == 0
    shown = plan(joined)
    assert shown.count("NestedLoop") <= 1 and "HashJoin" in shown or "SortMergeJoin" in shown


# --- streams --------------------------------------------------------------------


class Landing:
    """A folder in which files land, each later than the one before."""

    def __init__(self, folder):
        self.folder, self.count = folder, 0
        folder.mkdir()

    def land(self, rows):
        path = self.folder / f"f{self.count}.json"
        path.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(path, (1_700_000_000 + self.count * 10,) * 2)
        self.count += 1


def arrived(spark, landing, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing.folder))


def test_first_arrivals_over_restarts_and_late_rows(spark, tmp_path):
    landing, out, state = Landing(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "id string, t timestamp, n int, tags array<string>"

    def run():
        first = firsts.first_arrivals(arrived(spark, landing, schema), "id", "t", "2 hours", ["n"])
        arrivals.run_available(first, out, state).awaitTermination()
        return sorted((r["id"], r["n"]) for r in spark.read.schema(schema).parquet(out).collect())

    def row(key, minutes, n):
        return {"id": key, "t": at(minutes), "n": n, "tags": ["x", str(n)]}

    landing.land([row("a", 3, 2), row("a", 3, 1), row("b", 0, 3), row(None, 0, 4), row("", 0, 5), row("a", 9, 6)])
    landing.land([row("a", 20, 7), row("c", 15, 8)] + [row("hot", 30 + n, 100 + n) for n in range(50)])
    assert run() == [("a", 1), ("b", 3), ("c", 8), ("hot", 100)]
    # after a restart known keys are still known
    landing.land([row("b", 40, 9), row("d", 40, 10), row("hot", 41, 11)])
    assert run() == [("a", 1), ("b", 3), ("c", 8), ("d", 10), ("hot", 100)]
    # the watermark moves on: what is older than it is dropped, new keys still pass
    landing.land([row("e", 600, 12)])
    landing.land([row("e", 601, 15)])  # lateness is judged by the watermark before a batch
    landing.land([row("late", 30, 13), row("f", 500, 14)])
    assert run() == [("a", 1), ("b", 3), ("c", 8), ("d", 10), ("e", 12), ("f", 14), ("hot", 100)]
    tags = {r["n"]: r["tags"] for r in spark.read.schema(schema).parquet(out).collect()}
    assert tags[1] == ["x", "1"]


def test_windows_drop_late_rows_and_close_once(spark, tmp_path):
    landing, out, state = Landing(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "kind string, t timestamp, value double"

    def run():
        counts = windows.count_windows(arrived(spark, landing, schema), "t", "1 hour", "30 minutes", ["kind"], value=F.sum("value"))
        arrivals.run_available(counts, out, state).awaitTermination()
        return sorted((int((r["start"] - START).total_seconds() // 3600), r["kind"], r["rows"], r["value"])
                      for r in spark.read.schema(counts.schema).parquet(out).collect())

    def row(kind, minutes, value):
        return {"kind": kind, "t": at(minutes), "value": value}

    landing.land([row("x", 5, 1.0), row("x", 50, 2.0), row("y", 10, 4.0), row("x", None, 9.0)])
    assert run() == []  # nothing is sure yet
    landing.land([row("x", 70, 1.0), row("x", 55, 8.0)])  # late, within the delay
    landing.land([row("x", 95, 1.0)])
    assert run() == [(0, "x", 3, 11.0), (0, "y", 1, 4.0)]
    landing.land([row("x", 20, 100.0), row("x", 100, 1.0)])  # the first is too late now
    landing.land([row("x", 300, 1.0)])
    assert run() == [(0, "x", 3, 11.0), (0, "y", 1, 4.0), (1, "x", 3, 3.0)]


def test_sessions_grow_over_files(spark, tmp_path):
    landing, out, state = Landing(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "who int, t timestamp"
    landing.land([{"who": 1, "t": at(0)}, {"who": 1, "t": at(5)}, {"who": 2, "t": at(0)}])
    landing.land([{"who": 1, "t": at(12)}, {"who": 1, "t": at(40)}])
    landing.land([{"who": 3, "t": at(500)}])
    sessions = windows.count_sessions(arrived(spark, landing, schema), "t", "10 minutes", "5 minutes", ["who"])
    arrivals.run_available(sessions, out, state).awaitTermination()
    got = sorted((r["who"], r["start"], r["end"], r["rows"]) for r in spark.read.schema(sessions.schema).parquet(out).collect())
    assert got == [(1, at(0), at(22), 3), (1, at(40), at(50), 1), (2, at(0), at(10), 1)]


# --- sketches and subtotals -----------------------------------------------------


def test_sketches_merge_to_the_same_estimate(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("run"), (F.col("id") % 2).alias("split"),
        F.concat_ws(" ", F.lit("Word"), (F.col("id") % 20_000).cast("string")).alias("prediction"))
    fine = sketches.diversity_sketches(rows, ["run", "split"])
    merged = {(r["run"], r["measure"]): r for r in sketches.distinct_counts(sketches.merge_sketches(fine, ["run"])).collect()}
    whole = {(r["run"], r["measure"]): r for r in sketches.distinct_counts(sketches.diversity_sketches(rows, ["run"])).collect()}
    assert {k: v["total"] for k, v in merged.items()} == {k: v["total"] for k, v in whole.items()}
    for r in range(3):
        assert merged[r, "prediction"]["total"] == 20_000 and merged[r, "distinct_1"]["total"] == 40_000
        for found in (merged, whole):
            assert abs(found[r, "prediction"]["distinct"] / 20_000 - 1) < 0.02
            assert abs(found[r, "distinct_1"]["distinct"] / 20_001 - 1) < 0.02
    none = sketches.diversity_sketches(rows.filter("id < 0"), ["run"])
    assert sketches.distinct_counts(none).count() == 0


def test_subtotals_by_hand(spark):
    rows = [("r", "en", "a b a b"), ("r", "en", " a b "), ("r", None, "c"), ("s", "en", None)]
    df = spark.createDataFrame(rows, "run string, lang string, prediction string")
    got = {(r["grouping"], r["run"], r["lang"]): (round(r["duplicate_rate"], 6), round(r["distinct_1"], 6), round(r["distinct_2"], 6))
           for r in subtotals.diversity_by_sets(df, [["run", "lang"], ["run"], []]).collect()}
    assert got == {
        ("run,lang", "r", "en"): (0.0, round(2 / 6, 6), 0.5),
        ("run,lang", "r", None): (0.0, 1.0, 0.0),
        ("run,lang", "s", "en"): (0.0, 0.0, 0.0),
        ("run", "r", None): (0.0, round(3 / 7, 6), 0.5),
        ("run", "s", None): (0.0, 0.0, 0.0),
        ("", None, None): (0.0, round(3 / 7, 6), 0.5),
    }
    shown = plan(subtotals.diversity_by_sets(df, [["run", "lang"], ["run"], []]))
    assert shown.count("Generate ") == 1 and shown.count("Expand ") == 1
    assert shown.index("Expand ") < shown.index("Generate ")  # counts are repeated, not rows
