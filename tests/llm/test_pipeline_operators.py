"""Quality rules, line dedup, near duplicates, mixing and packing against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papercorpus.llm import line_dedup, mixing, near_duplicates, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def known(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
def test_quality_measures(table, request):
    docs = request.getfixturevalue(table)
    judged = quality_rules.judge(docs).select("text", "quality.*").collect()
    assert len(judged) == docs.count()
    for r in judged:
        assert tuple(r[c] for c in quality_rules.COUNTS[:5]) == known(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_columns(odd):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {15}


def text_key(text):
    """Spark's xxhash64 of a text; a null has the seed."""
    value = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - 2**64 if value >= 2**63 else value


def brute_lines(rows, edit_words=8):
    """doc_id, text -> new text, by comparing every line with all before it."""
    def places(i, t):
        return [] if t is None else [((i if i is not None else -(2**63), text_key(t), n), tuple(WORD.findall(low(x))))
                                     for n, x in enumerate(t.split("\n"))]

    lines = sorted({x for i, t in rows for x in places(i, t) if x[1]})
    first, away = {}, set()
    for at, words in lines:
        near = len(words) >= edit_words and any(
            len(other) >= edit_words and line_dedup.within_one(list(other), list(words)) for other in first)
        if words in first or near:
            away.add(at)
        first.setdefault(words, at)
    out = []
    for i, t in rows:
        kept = [x for x, (at, _) in zip((t or "").split("\n"), places(i, t), strict=False) if at not in away]
        out.append((i, None if t is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
def test_line_dedup(table, request):
    docs = request.getfixturevalue(table)
    got = line_dedup.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = tuples(docs.select("doc_id", "text"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(tuples(got.select("doc_id", "text")), key=order) == sorted(brute_lines(rows), key=order)


def test_line_dedup_all_edits(spark):
    words = [f"v{i}" for i in range(9)]
    texts = [words] + [words[:i] + ["z"] + words[i + 1 :] for i in range(9)] + [words[:i] + words[i + 1 :] for i in range(9)]
    texts += [words[:i] + ["q"] + words[i:] for i in range(10)] + [["u", "t", *words[2:]], [*words[:-2], "u", "t"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted(tuples(line_dedup.dedup_lines(docs).select("doc_id", "text")))
    assert got == brute_lines(sorted(tuples(docs)))
    assert [i for i, t in got if t] == [0, 29, 30]


def test_line_dedup_of_rows_that_share_an_id(spark):
    """A line is compared with its own text's lines only, whatever ids the texts share."""
    e = [f"e{i}" for i in range(10)]
    a = [f"a{i}" for i in range(10)]
    b = [*e[:9], "other"]
    c = [*a[:5], *(f"c{i}" for i in range(5))]
    rows = [(1, " ".join(e)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join(c))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuples(line_dedup.dedup_lines(docs).select("doc_id", "text")))
    assert got == sorted([(1, " ".join(e)), (5, " ".join(a)), (5, ""), (9, " ".join(c))]) == sorted(brute_lines(rows))


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "one\ntwo three\n\nfour"), (2, "ONE\n\ntwo  three\nfour five"), (3, "two four\none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuples(line_dedup.dedup_lines(docs).select("doc_id", "text")))
    assert got == [(1, "one\ntwo three\n\nfour"), (2, "\nfour five"), (3, "two four")] == sorted(brute_lines(rows))


def test_brackets_are_no_symbols():
    assert quality_rules.measure([b"a [b] c", b"#*$%&|<>[]"])[:, 2].tolist() == [0, 8]


def test_line_dedup_of_many_null_ids_and_a_long_text(spark):
    words = " ".join(f"w{i}" for i in range(9))
    nulls = spark.range(10_000).selectExpr("cast(null as bigint) as doc_id", f"concat('{words} ', cast(id % 4000 as string), ' end') as text")
    long = "\n".join(f"{words} {k % 60_000} tail {k % 60_000}" for k in range(100_000))
    docs = nulls.unionByName(spark.createDataFrame([(1, long)], "doc_id bigint, text string"))
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_removed").collect()
    assert len(got) == 10_001
    left = [r["text"] for r in got if r["doc_id"] is None and r["text"]]
    assert len(set(left)) == 1  # all are one edit from one another; equal rows are one place
    assert next(r["n_removed"] for r in got if r["doc_id"] == 1) == 40_000


@given(st.lists(st.sampled_from(["a", "b"]), max_size=6), st.lists(st.sampled_from(["a", "b"]), max_size=6))
def test_within_one(x, y):
    alike = x == y or len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) == 1 or any(
        short == long[:i] + long[i + 1 :] for short, long in ((x, y), (y, x)) for i in range(len(long)))
    assert line_dedup.within_one(x, y) == alike


def shingles(text, n):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), find(i) if s and i is not None else i) for i, s in sets), key=str)


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(table, n, percent, request):
    docs = request.getfixturevalue(table)
    got = near_duplicates.near_duplicates(docs, n, percent)
    rows = tuples(got)
    assert sorted((r[:3] for r in rows), key=str) == brute_components(tuples(docs.select("doc_id", "text")), n, percent)
    assert all(r[3] == (r[0] is None or r[0] == r[2]) for r in rows)


def test_near_duplicates_chains(spark):
    """Long chains of edits, where ends are unlike, and a bucket with several groups."""
    words = [f"v{i}" for i in range(100)]
    texts = []
    for step in range(12):
        texts.append(" ".join(words))
        words = [*words[4:], *(f"n{step}-{k}" for k in range(4))]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"t{g}-{i}" for i in range(55)) + f" end{k}" for g in range(4) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((tuple(r)[:3] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == brute_components(list(enumerate(texts)), 3, 85)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, goal = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weights[s] for s in free)
        cut = {s for s in free if level * weights[s] > 2 * sizes[s]}
        for s in cut or free:
            goal[s] = 2.0 * sizes[s] if cut else level * weights[s]
            left -= goal[s] if cut else 0
        free -= cut or free
    return goal


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
@pytest.mark.parametrize("shard_docs", [20_000, 7])
def test_mixing(table, shard_docs, request):
    docs = request.getfixturevalue(table)
    rows = mixing.mix(docs, shard_docs=shard_docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    goal = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
    cells = len(rows) / shard_docs + 1
    for s, words in taken.items():
        assert abs(words - goal[s]) <= mixing.BLOCK * cells
    again = mixing.mix(docs.repartition(3), shard_docs=shard_docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_quotas_are_highest_quotients(spark):
    cells = [("a", k, size) for k, size in enumerate([1, 1, 7, 90, 1000, 3, 5000, 64, 0])]
    total = sum(c[2] for c in cells)
    for target in (64.0, 6400.0, 1.5 * total, 2.0 * total):
        df = spark.createDataFrame([(*c, total, target) for c in cells],
                                   "source string, shard long, cell_size long, source_size long, target double")
        got = {r["shard"]: r["blocks"] for r in mixing.quotas(df).collect()}
        seats = [0] * len(cells)
        for _ in range(round(target / mixing.BLOCK)):
            best = max(range(len(cells)), key=lambda k: (cells[k][2] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert [got[k] for k in range(len(cells))] == seats


def test_full_cells_pass_their_blocks_on(spark):
    cells = [("a", k, size) for k, size in enumerate([10, 20, 33, 500, 900])]
    total = sum(c[2] for c in cells)
    for target in (1.9 * total, 2.0 * total):
        df = spark.createDataFrame([(*c, total, target) for c in cells],
                                   "source string, shard long, cell_size long, source_size long, target double")
        got = {r["shard"]: r["blocks"] for r in mixing.quotas(df, 2.0).collect()}
        caps = [-(-2 * c[2] // mixing.BLOCK) for c in cells]
        seats = [0] * len(cells)
        for _ in range(round(target / mixing.BLOCK)):
            open_ = [k for k in range(len(cells)) if seats[k] < caps[k]]
            if open_:
                seats[max(open_, key=lambda k: (cells[k][2] / (2 * seats[k] + 1), -k))] += 1
        assert [got[k] for k in range(len(cells))] == seats


def test_many_null_ids_and_repeated_rows_are_mixed(spark):
    nulls = spark.range(6_000).selectExpr("cast(null as bigint) as doc_id", "concat('a b c d e f g ', cast(id % 3000 as string)) as text", "'s' as source")
    same = spark.range(5_000).selectExpr("7L as doc_id", "'one row again and again' as text", "'t' as source")
    rows = mixing.mix(nulls.unionByName(same), shard_docs=500).collect()
    assert len(rows) == 11_000
    taken = defaultdict(int)
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in rows}
    assert all(abs(taken[s] - goal[s]) <= mixing.BLOCK * 23 for s in goal)
    copies = mixing.take(nulls.unionByName(same), shard_docs=500)
    words = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
def test_take(table, request):
    docs = request.getfixturevalue(table)
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got, whole = mixing.take(docs), {}
    assert got.columns == docs.columns
    words = defaultdict(int)
    for r in docs.collect():
        whole.setdefault(r["doc_id"], []).append(r["text"])
    for r in got.collect():
        assert any((t or "").startswith(r["text"]) for t in whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    for doc_id, texts in whole.items():
        assert words[doc_id] == taken[doc_id]


@pytest.mark.parametrize("table", ["documents", "odd", "nothing"])
def test_packing(table, request):
    docs = request.getfixturevalue(table)
    rows = packing.pack(docs, group=50).collect()
    expected = sorted((r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    whole, bins = [], defaultdict(list)
    for r in rows:
        if r["piece"] == 0:
            whole.append(r["doc_id"] or 0)
        assert r["start"] == r["piece"] * 2048
        if r["length"]:
            bins[r["bin"]].append((r["place"], r["length"], r["capacity"]))
        else:
            assert r["bin"] is None
    assert sorted(whole) == [e[0] for e in expected]
    assert sum(r["length"] for r in rows) == sum(e[1] for e in expected)
    for content in bins.values():
        end = 0
        for place, length, _ in sorted(content):
            assert place == end
            end += length
        assert content[0][2] == min(c for c in packing.CAPACITIES if c >= end)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    bins, offsets, capacities = packing.best_fit(lengths, (16, 32, 64), 2)
    used = defaultdict(int)
    for i in sorted(range(len(lengths)), key=lambda i: (bins[i], offsets[i])):
        assert offsets[i] == used[bins[i]]
        used[bins[i]] += lengths[i]
    assert [min(c for c in (16, 32, 64) if c >= used[b]) for b in range(len(used))] == capacities


def test_best_fit_opens_the_cheapest():
    assert packing.best_fit([10], (16, 32, 64), 2)[2] == [16]
    bins, _, capacities = packing.best_fit([16] * 4, (16, 32, 64), 2)
    assert capacities == [64] and set(bins) == {0}
