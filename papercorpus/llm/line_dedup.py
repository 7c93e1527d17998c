"""Line dedup by a deletion-neighbourhood join over words, with an edit bound of one word.

Two lines are alike if they have the same words (A-Z in lower case), or, from EDIT_WORDS
words on, if their words differ by one inserted, deleted or replaced word: the edit bound
is an eighth of a line, one word at most. Every line within the bound emits its variants, each
with one word left out, as hashed keys; equal keys bring alike lines together:

* replaced word: both lines leave out the word at the same place i, so the key holds the
  variant and i. All lines of such a key are alike, so each needs only the earliest one.
* inserted or deleted word: the variant of one line is the other line itself. Each line
  needs the earliest of the other sort.

So a key held by any number of lines is one aggregated row, never pairs. Before that, an
exact filter spares most lines the variants: alike lines share their first or their last
words up to the middle, so a line without a partner there has no partner at all.

Lines are known by their hashes and found again by the hash of their whole text, never by
doc_id, so null and repeated ids are keys like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, spare
from .words import BASE, U64, Texts, as_bytes, mix64, owner, powers, runs

#: Words from which on a line may differ in one: below, one word is more than an eighth of the line.
EDIT_WORDS = 8


class Spans:
    """Hashes of runs of words, and of lines without one of their words."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = powers(len(words) + 1)
        self.sum = np.concatenate([np.zeros(1, U64), np.cumsum(words * self.up[: len(words)], dtype=U64)])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sum[b] - self.sum[a]) * self.down[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64(self.raw(a, b) + (b - a).astype(U64))

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of words a..b except word i, equal to ``of`` that shorter line."""
        joined = self.raw(a, i) + self.raw(i + 1, b) * self.up[i - a]
        return mix64(joined + (b - a - 1).astype(U64))


def _lines_of(texts: list[bytes]):
    """Words, and text, number, word bounds of each line that has a word."""
    t = Texts([x.lower() for x in texts])
    begin, end, first = t.lines()
    a, b = np.searchsorted(t.starts, begin), np.searchsorted(t.starts, end)
    keep = b > a
    text = owner(first)
    number = np.arange(len(begin)) - first[text]
    return t.words(), text[keep], number[keep], a[keep], b[keep]


def _line_rows(texts: list[bytes], least: int) -> list[np.ndarray]:
    """Text, number, two hashes, whether the line has ``least`` words, and its half-line keys."""
    words, text, number, a, b = _lines_of(texts)
    spans, other = Spans(words), Spans(mix64(words ^ U64(BASE)))
    half = np.maximum((b - a) // 2, 1)
    keys = [mix64(hashed ^ mix64((k * 2 + side).astype(U64) + U64(1)))
            for k in (half, half - 1)
            for side, hashed in ((0, spans.of(a, a + k)), (1, spans.of(b - k, b)))]
    return [text, number, spans.of(a, b), other.of(a, b), b - a >= least, *keys]


KEYS = ["k1", "k2", "k3", "k4"]
_LINES = "array<struct<line:int,one:bigint,two:bigint,k1:bigint,k2:bigint,k3:bigint,k4:bigint>>"


def _lines(least: int):
    def lines(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        counts, columns = [np.zeros(1, np.int64)], [[] for _ in range(8)]
        for a, b in runs(rows):
            text, *values = _line_rows(rows[a:b], least)
            counts.append(np.bincount(text, minlength=b - a))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        number, one, two, long, *keys = [np.concatenate(c) if c else np.zeros(0, U64) for c in columns]
        kinds = [pa.array(number.astype(np.int32)), *(pa.array(c.astype(U64).view(np.int64)) for c in (one, two)),
                 *(pa.array(c.astype(U64).view(np.int64), mask=~long.astype(bool)) for c in keys)]
        structs = pa.StructArray.from_arrays(kinds, names=["line", "one", "two", *KEYS])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), structs)

    return F.arrow_udf(lines, _LINES).asNondeterministic()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = as_bytes(batch.column("words"))
        for p, q in runs(rows):
            t = Texts(rows[p:q])
            words, text, a, b = t.words(), owner(t.first), t.first[:-1], t.first[1:]
            spans, i = Spans(words), np.arange(len(words))
            cut = spans.without(a[text], b[text], i)
            place = i - a[text]
            keys = np.concatenate([mix64(cut ^ mix64(place.astype(U64) + U64(3))), cut, spans.of(a, b)])
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(i), len(i), q - p])
            line = np.concatenate([text, text, np.arange(q - p)]) + p
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(kind),
                 *(batch.column(c).take(pa.array(line)) for c in ("one", "doc_id", "text_key", "line"))],
                names=["key", "kind", "one", "doc_id", "text_key", "line"])


def within_one(x: list[bytes], y: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most turns x into y."""
    if abs(len(x) - len(y)) > 1:
        return False
    start = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    x, y = x[start:], y[start:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(as_bytes(batch.column("words")), as_bytes(batch.column("other")), strict=True)
        keep = pa.array([within_one(x.split(), y.split()) for x, y in pairs], pa.bool_())
        yield batch.select(["one", "two"]).filter(keep)


def _rebuilt():
    def rebuilt(texts: pa.Array, drops: pa.Array) -> pa.Array:
        rows, lists = as_bytes(texts), drops.to_pylist()
        out, valid = [], [t is not None for t in texts.to_pylist()]
        for a, b in runs(rows):
            text, number, one, *_ = _line_rows(rows[a:b], 1)
            hashes = dict(zip(zip(text.tolist(), number.tolist(), strict=True), one.view(np.int64).tolist(), strict=True))
            for i in range(a, b):
                away = {d["line"] for d in lists[i] or () if hashes.get((i - a, d["line"])) == d["one"]}
                lines = rows[i].split(b"\n")
                kept = [x for k, x in enumerate(lines) if k not in away]
                out.append((b"\n".join(kept).decode() if valid[i] else None, len(lines) if valid[i] else 0, len(away)))
        return pa.StructArray.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64())], names=["text", "n_lines", "n_removed"])

    return F.arrow_udf(rebuilt, "struct<text:string,n_lines:bigint,n_removed:bigint>").asNondeterministic()


NO_ID = -(2**63)


def _place(*names: str) -> Column:
    """Order of lines: doc_id (null first), hash of the text, line number."""
    doc_id, *rest = names
    return F.struct(F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("doc_id"), *rest)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), *more)


def repeated_lines(docs: DataFrame, scratch: Scratch, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(doc_id, text_key, line, one) of the lines that have an alike line before them.

    Before: smaller (doc_id, hash of the text, line number), null ids first. Lines count from 0.
    """
    place = _place("doc_id", "text_key", "line")
    found = scratch.store(_keyed(docs, F.inline(_lines(edit_words)(F.col("text").cast("binary")))), "lines")
    kinds = scratch.store(found.groupBy("one", "two").agg(
        F.min(place).alias("place"), *(F.min(k).alias(k) for k in KEYS)), "kinds-of-line")

    # half lines held by two kinds or more; the others are most, and go before their kinds are shuffled
    halves = kinds.filter(F.col(KEYS[0]).isNotNull()).select("one", F.explode(F.array_distinct(F.array(*KEYS))).alias("half"))
    twice = halves.groupBy("half").agg(F.min("one").alias("low"), F.max("one").alias("high")).filter("low < high")
    paired = halves.join(twice.select("half"), "half", "left_semi").select("one").distinct()
    wanted = scratch.store(kinds.join(paired, "one", "left_semi").select("one", "two", "place"), "wanted")

    per_text = scratch.store(wanted.groupBy(F.col("place.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("one", "two", F.col("place.doc_id").alias("doc_id"), F.col("place.line").alias("line"))).alias("wanted")), "per-text")
    # equal texts are one: a text that a third of all rows repeat is fetched once; the texts are met by
    # hash, not sorted, and in the same way at any size
    texts = _keyed(docs, F.col("text")).join(per_text.select("text_key").hint("shuffle_hash"), "text_key", "left_semi").groupBy("text_key").agg(
        F.min("text").alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    picked = F.flatten(F.transform(F.array(F.split(lower, "\n")), lambda parts: F.transform("wanted", lambda w: F.struct(
        w["one"].alias("one"), w["two"].alias("two"), w["doc_id"].alias("doc_id"), w["line"].alias("line"),
        F.get(parts, w["line"]).cast("binary").alias("words")))))  # a text is split once, whatever is picked from it
    lines = scratch.store(texts.join(per_text, "text_key").select("text_key", F.inline(picked)).select(
        "one", "two", "doc_id", "text_key", "line", "words").filter("words is not null"), "line-texts")
    scratch.drop(wanted, per_text)

    rows = scratch.store(lines.mapInArrow(
        _variants, "key bigint, kind tinyint, one bigint, doc_id bigint, text_key bigint, line int"), "variants")
    at = F.struct("doc_id", "text_key", "line", "one")
    groups = rows.groupBy("key").agg(
        F.count("*").alias("n"),
        *(F.min(F.when(F.col("kind") == k, at)).alias(f"first_{k}") for k in range(3))).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == 0, F.col("first_0")).when(F.col("kind") == 1, F.col("first_2")).otherwise(F.col("first_1"))
    where = [F.struct(*(F.col(f"{side}.{c}") for c in ("doc_id", "text_key", "line"))) for side in ("partner", "at")]
    earlier = rows.join(groups, "key").select("one", at.alias("at"), partner.alias("partner")).filter(where[0] < where[1])
    pairs = scratch.store(earlier.groupBy("one").agg(F.min("partner").alias("partner")), "partners")
    scratch.drop(rows)
    others = lines.select(F.col("one").alias("p_one"), F.col("words").alias("other"))
    near = scratch.store(
        pairs.select("one", F.col("partner.one").alias("p_one")).join(lines.select("one", "two", "words"), "one").join(others, "p_one")
        .select("one", "two", "words", "other").mapInArrow(_verified, "one bigint, two bigint").distinct(), "near-lines")
    scratch.drop(lines, pairs)

    late = found.join(kinds.select("one", "two", "place"), ["one", "two"]).join(
        near.withColumn("near", F.lit(True)), ["one", "two"], "left").filter(F.col("near") | (place != F.col("place")))
    drops = scratch.store(late.select("doc_id", "text_key", "line", "one"), "repeated-lines")
    scratch.drop(found, kinds, near)
    return drops


def dedup_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without lines that an earlier line resembles, and with n_lines, n_removed.

    Whether a line goes does not depend on whether the earlier one stays. Lines without
    a word always stay. Rows that repeat doc_id and text hold the same places, so
    neither is before the other; rows that share an id (or have none) with other texts are
    ordered by the hash of the text. A null text stays null (no lines); an empty text is one
    empty line. Columns called n_lines or n_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    of, key, gone, new = (spare(name, docs) for name in ("_of", "_key", "_gone", "_new"))
    per_text = repeated_lines(docs, scratch, edit_words).groupBy(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(of), F.col("text_key").alias(key)).agg(F.collect_set(F.struct("line", "one")).alias(gone))
    own = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == per_text[of]) & (F.xxhash64(docs["text"].cast("binary")) == per_text[key])
    joined = docs.join(per_text.hint("shuffle_hash"), own, "left")
    built = joined.withColumn(new, _rebuilt()(F.col("text").cast("binary"), F.col(gone)))
    return built.withColumns({"text": F.col(new)["text"], "n_lines": F.col(new)["n_lines"],
                              "n_removed": F.col(new)["n_removed"]}).drop(of, key, gone, new)
