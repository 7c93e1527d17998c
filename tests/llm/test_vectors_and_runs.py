"""Hard negatives, nearest neighbours and periodic runs against brute force and SQL."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from papercorpus.llm import hard_negatives, nearest, oracles, periodic_runs, queries
from papercorpus.llm.words import Texts

from ..comparing import differences

VECTORS = "vec_id bigint, embedding array<float>, label int, vector string, rank int, _row int"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(name, spark, folder, duck):
    assert differences(queries.QUERIES[name], oracles.ORACLES[name], spark, folder, duck) == []


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, empty, zero, short and unfinished vectors, ties, repeated ids, clashing columns."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.randrange(3)) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.0, -0.5, 0.25, 1.0], i % 2) for i in range(40)]  # all alike
    rows += [(200, [0.0] * 6, 1), (201, [1.0], 1), (202, [], 1), (203, None, 1), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
             (205, [float("nan")] + [0.0] * 5, 1), (206, [float("inf")] + [0.0] * 5, 1), (207, [0.1] * 6, None), (None, [0.1] * 6, 1),
             (208, [0.3] * 6, 2), (208, [0.3] * 6, 2), (208, [0.2] * 6, 2), (-40, [0.9] * 6, 0)]
    return spark.createDataFrame([(i, v, label, "c", 0, 0) for i, v, label in rows], VECTORS)


def usable(rows):
    out = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        out.setdefault(r["vec_id"], []).append((r["label"], list(v)))
    return out


def mined(rows, k=5):
    """Hard negatives by looking at all pairs."""
    kept = {}
    for i, found in usable(rows).items():
        found = sorted((label, [int(np.floor(x * 256)) for x in v]) for label, v in found if label is not None)
        if found:
            kept[i] = found[0]

    def score(i, j):
        return sum(x * y for x, y in zip(kept[i][1], kept[j][1], strict=False))

    out = []
    for a in (i for i in kept if i % 20 == 0):
        first = sorted((j for j in kept if j != a and kept[j][0] == kept[a][0]), key=lambda j: (-score(a, j), j))[:k]
        for p in first:
            low, high = 80 * score(a, p), 100 * score(a, p)
            inside = [j for j in kept if kept[j][0] != kept[a][0] and low <= 100 * score(a, j) <= high]
            inside.sort(key=lambda j: (-score(a, j), j))
            out += [(a, p, n + 1, j, score(a, p), score(a, j)) for n, j in enumerate(inside[:k])]
    return sorted(out)


def test_hard_negatives_of_odd_rows(odd_vectors):
    rows = hard_negatives.whole_numbers(odd_vectors)
    got = hard_negatives.mine(rows, rows.filter("vec_id % 20 = 0"))
    expected = mined(odd_vectors.collect())
    assert len(expected) > 20
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_hard_negatives_of_many_blocks(odd_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives.blocks, "ROWS", 16)
    monkeypatch.setattr(hard_negatives.blocks, "ASKERS", 2)
    rows = hard_negatives.whole_numbers(odd_vectors)
    got = hard_negatives.mine(rows, rows.filter("vec_id % 20 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == mined(odd_vectors.collect())


def test_threshold_stops_early_and_meets_ties():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-5, 6, (3000, 4))
    vectors[:, 0] += np.where(np.arange(3000) < 40, 300, 0)
    lists = hard_negatives.Lists(vectors)
    anchor = np.array([9, 1, 0, -1])
    met = 0
    for new, _, threshold in lists.rounds(anchor):
        met += len(new)
        if threshold is not None and threshold < 9 * 250:
            break
    assert met < 1500
    found = hard_negatives.top_in_windows(lists, np.arange(3000), np.ones(3000, bool), anchor, [(None, None), (0, 4000)], 5)
    scores = vectors @ anchor
    for (ids, points), inside in zip(found, (scores == scores, (scores >= 0) & (scores <= 40)), strict=True):
        order = sorted(np.flatnonzero(inside), key=lambda i: (-scores[i], i))[:5]
        assert ids.tolist() == order and points.tolist() == scores[order].tolist()


def test_hard_negatives_of_nothing(odd_vectors):
    rows = hard_negatives.whole_numbers(odd_vectors.filter("vec_id > 1000"))
    assert hard_negatives.mine(rows, rows).count() == 0
    one = hard_negatives.whole_numbers(odd_vectors.filter("vec_id = 0"))
    assert hard_negatives.mine(one, one).count() == 0


def by_inner_product(kept, queries_, k):
    out = {}
    for q in queries_:
        scored = sorted(((-sum(x * y for x, y in zip(kept[q], kept[i], strict=False)), i) for i in kept if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_of_odd_rows(odd_vectors):
    kept = {i: min(v for _, v in found if any(v)) for i, found in usable(odd_vectors.collect()).items() if any(any(v) for _, v in found)}
    rows = nearest.usable_vectors(odd_vectors)
    assert {r["vec_id"]: r["vector"] for r in rows.collect()} == kept
    got = nearest.nearest(rows, rows.filter("vec_id % 20 = 0"), k=8, share=1.0)
    expected = by_inner_product(kept, [i for i in kept if i % 20 == 0], 8)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    hits = sum(len({i for i, _ in expected[q]} & {i for _, i, _ in found[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, rows_ in found.items():
        assert [n for n, _, _ in rows_] == list(range(1, len(expected[q]) + 1))
        assert rows_ == sorted(rows_, key=lambda r: (-r[2], r[1]))
        for _, i, s in rows_:
            assert s == pytest.approx(sum(x * y for x, y in zip(kept[q], kept[i], strict=False)), abs=1e-12)


def test_nearest_recall(spark, folder):
    got = queries.op12_nearest_neighbours(spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found = got[got.query_id == ids[q]]
        assert len(found) == 20 and set(found["rank"]) == set(range(1, 21))
        hits += len(set(best) & set(found.vec_id))
    assert hits >= 0.9 * len(got)


def test_nearest_of_nothing(odd_vectors):
    rows = nearest.usable_vectors(odd_vectors)
    assert nearest.nearest(rows.filter("vec_id > 1000"), rows, 5).count() == 0
    assert nearest.nearest(rows, rows.filter("vec_id > 1000"), 5).count() == 0
    alone = rows.filter("vec_id = 0")
    assert nearest.nearest(alone, alone, 5).count() == 0


def test_index_finds_every_code_within_a_radius():
    codes = np.random.default_rng(1).integers(0, 256, (2000, 8)).astype(np.uint8)
    codes[:50] = codes[0] ^ np.random.default_rng(2).integers(0, 2, (50, 8)).astype(np.uint8)
    index = nearest.Index(codes)
    for radius in (0, 1, 5, 7, 8, 20, 30, 64):
        expected = np.flatnonzero(nearest.distances(codes[0], codes) <= radius)
        assert index.within(codes[0], radius).tolist() == expected.tolist()


def all_runs(words, least=12):
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                best.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n = rng.choice([0, 1, 5, 12, 13, 30, 60, 90])
            words = [rng.choice("abcdefghi"[: rng.choice([1, 2, 3, 9])]) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                words = [words[min(n - 1, i if i < a else a + (i - a) % p)] for i in range(n)]
            docs.append(words)
        least = rng.choice([12, 12, 2, 4, 7])
        t = Texts([" ".join(d).encode() for d in docs])
        got = periodic_runs.word_runs(t.words(), t.first, least).tolist()
        for i, d in enumerate(docs):
            assert [tuple(r[1:]) for r in got if r[0] == i] == all_runs(d, least)


def test_runs_of_odd_rows(odd):
    got = {(r["doc_id"], r["text"]): r["periodic"] for r in periodic_runs.collapse_runs(odd.withColumn("periodic", F.lit(1))).collect()}
    assert len(got) == len({(r["doc_id"], r["text"]) for r in odd.collect()})
    for (_, text), found in got.items():
        words = (text or "").encode().split()
        assert found["n_words"] == len(words)
        if len(words) < 2000:
            expected = all_runs(words)
            assert [tuple(r) for r in found["runs"]] == expected
            away = {i for s, size, p in expected for i in range(s + p, s + size)}
            assert found["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in away)
    long = next(v for (i, _), v in got.items() if i == 3)
    assert [tuple(r) for r in long["runs"]] == [(0, 30_000, 977)]


def test_runs_stay_fast_on_one_long_text():
    rng = random.Random(2)
    for words in (["a"] * 100_000, [rng.choice("ab") for _ in range(50_000)],
                  [w for i in range(10_000) for w in (str(i), *"is the best thing you can buy today".split())]):
        t = Texts([" ".join(words).encode()])
        periodic_runs.word_runs(t.words(), t.first)


def test_tails_become_periodic(spark):
    ids = [i for i in range(60) if crc32(str(i).encode()) % 10 == 0][:3] + [None, 1]
    rows = [(i, " ".join(f"w{k}" for k in range(50))) for i in ids] + [(ids[0], None), (ids[0], "  ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in df.select("doc_id", "text", periodic_runs.repeat_tails("doc_id", "text").cast("string").alias("new")).collect():
        words, h = (r["text"] or "").split(), crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode())
        if h % 10 or not words:
            assert r["new"] == (r["text"] or "")
            continue
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        assert r["new"].split() == [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_of_nothing(nothing):
    assert periodic_runs.collapse_runs(nothing).count() == 0
