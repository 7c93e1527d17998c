"""The pipeline: each stage on what the one before it kept, against brute force, and on odd and empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from papercorpus.llm import mixing, near_duplicates, quality_rules

from .test_pipeline_operators import WORD, brute_lines, shingles


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
def test_stages(table, request, spark, folder):
    docs = request.getfixturevalue(table).cache()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]

    good = corpus_pipeline.quality(spark, docs, folder).cache()
    verdict = [(r["doc_id"], r["text"]) for r in quality_rules.judge(docs).collect() if r["quality"]["kept"]]
    assert sorted(rows_of(good), key=str) == sorted(verdict, key=str) and good.columns == docs.columns

    lines = corpus_pipeline.lines(spark, good, folder).cache()
    expected = [(i, new) for (i, new), (_, old) in zip(brute_lines(rows_of(good)), rows_of(good), strict=True) if new or new == old]
    assert sorted(rows_of(lines), key=str) == sorted(expected, key=str) and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())

    single = corpus_pipeline.near_duplicates(spark, lines, folder).cache()
    found = near_duplicates.near_duplicates(lines).collect()
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(r["doc_id"] for r in found if r["kept"])
    sets = [shingles(t, 5) for _, t in rows_of(single) if WORD.search(t or "")]
    for k, x in enumerate(sets):
        for y in sets[:k]:
            assert 100 * len(x & y) < 80 * len(x | y)

    mixed = corpus_pipeline.mixing(spark, single, folder).cache()
    taken = defaultdict(int)
    for r in mixing.mix(single).collect():
        taken[r["doc_id"]] += r["taken"]
    words = defaultdict(int)
    for i, t in rows_of(mixed):
        words[i] += len(WORD.findall(t))
    assert {i: n for i, n in taken.items() if n} == dict(words) and mixed.columns == docs.columns

    packed = corpus_pipeline.packing(spark, mixed, folder).collect()
    assert sum(r["length"] for r in packed) == sum(words.values())
    bins = defaultdict(int)
    for r in packed:
        bins[r["bin"]] += r["length"]
    assert all(n <= r["capacity"] for r in packed if r["bin"] is not None for n in [bins[r["bin"]]])


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == docs.columns
    keep = [c for c in got.columns if c in ("doc_id", "piece", "start", "length")]
    assert Counter(map(tuple, got.select(keep).collect())) == Counter(map(tuple, docs.select(keep).collect()))
