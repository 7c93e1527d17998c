"""Nearest neighbours by multi-index hashing over learnt rotated binary codes.

* Codes: vectors are brought to one length (a further component takes up what a vector is
  short of the longest, so the largest inner product is the smallest angle), rotated, and
  each of 64 coordinates gives the bit of its sign. The rotation is learnt from a bounded
  sample by turns: the nearest signs for the rotation, the nearest rotation for the signs.
* Index: a code is cut into eight substrings of eight bits; in every block each substring
  has a table from its value to the rows that have it.
* Search: a code within Hamming radius r = 8a + b of the query's agrees with it up to a
  bits in one of the first b + 1 substrings, or up to a - 1 in one of the others. So these
  buckets together hold every code within the radius; those are kept, and ranked by the
  inner products of the original vectors.

The radius is learnt too: the true neighbours of a few sampled queries are looked up among
all rows, and the radius holds the asked share of them. A query that finds fewer than k
rows in a block asks there again with a larger radius, up to all of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .scratch import Scratch

BITS, PARTS = 64, 8
SAMPLE, TRIED, ROUNDS, SHARE, MARGIN = 8192, 128, 40, 0.97, 2

_apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
#: NEAR[d][v]: the values within d bits of v.
NEAR = [[np.flatnonzero(row <= d) for row in _apart] for d in range(9)]


class Codes(NamedTuple):
    """Length that all vectors are brought to, and the rotation (width + 1 rows, BITS columns)."""

    longest: float
    rotation: np.ndarray

    def width(self) -> int:
        return len(self.rotation) - 1

    def of(self, vectors: np.ndarray, asking: bool = False) -> np.ndarray:
        """Codes as rows of PARTS bytes."""
        return np.packbits(self._turned(vectors, asking) > 0, axis=1)

    def _turned(self, vectors: np.ndarray, asking: bool) -> np.ndarray:
        return lengthened(vectors, self.longest, asking) @ self.rotation


def lengthened(vectors: np.ndarray, longest: float, asking: bool) -> np.ndarray:
    """Vectors of one length with the further component; of askers it is 0."""
    scaled = vectors / longest
    rest = np.zeros(len(vectors)) if asking else np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def learn_codes(sample: np.ndarray, longest: float, seed: int = 42) -> Codes:
    """Rotation under which the sample lies nearest to its own signs."""
    x = lengthened(sample, longest, False)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:BITS].T  # the directions along which the sample is longest
    kept = np.zeros((x.shape[1], BITS))
    kept[:, : axes.shape[1]] = axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS, BITS)))
    flat = x @ kept
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return Codes(longest, kept @ turn)


def distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64)[:, 0] ^ code.view(np.uint64)[0])


class Index:
    """The tables of a block: for each substring, rows by value and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.rows = np.argsort(codes, axis=0, kind="stable").T
        self.begin = np.stack([np.searchsorted(np.sort(codes[:, t]), np.arange(257)) for t in range(PARTS)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` bits of ``code``."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        most, extra = divmod(radius, PARTS)
        met = np.zeros(len(self.codes), bool)
        for t in range(PARTS):
            reach = most if t <= extra else most - 1
            if reach >= 0:
                begin, rows = self.begin[t], self.rows[t]
                values = NEAR[reach][code[t]]
                for a, b in zip(begin[values].tolist(), begin[values + 1].tolist(), strict=True):
                    if a < b:
                        met[rows[a:b]] = True
        found = np.flatnonzero(met)
        return found[distances(code, self.codes[found]) <= radius]


def inner(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed alike wherever its row stands."""
    return np.einsum("ij,j->i", rows, vector)


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _found(names: tuple[str, str, str], parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    sizes = [len(p[1]) for p in parts]
    return pa.table({
        names[0]: pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes)),
        names[1]: pa.array(np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])),
        names[2]: pa.array(np.concatenate([np.zeros(0), *(p[2] for p in parts)]))})


def _search(codes: Codes, radius: int, k: int):
    def search(asking: pa.Table, rows: pa.Table) -> pa.Table:
        vectors, ids = blocks.matrix(rows["vector"], codes.width()), rows["vec_id"].to_numpy()
        asked = blocks.matrix(asking["vector"], codes.width())
        index, asked_codes = Index(codes.of(vectors)), codes.of(asked, True)
        out = []
        for q, vector, code in zip(asking["vec_id"].to_pylist(), asked, asked_codes, strict=True):
            reach = radius
            while True:
                found = index.within(code, reach)
                found = found[ids[found] != q]
                if len(found) >= k or reach >= BITS:
                    break
                reach = min(BITS, reach + 4)
            scores = inner(vectors[found], vector)
            top = first_of(ids[found], scores, k)
            out.append((q, ids[found[top]], scores[top]))
        return _found(("query_id", "vec_id", "score"), out)

    return search


def _nearest_of(tried: list[tuple[int, list[float]]], codes: Codes, k: int):
    """True neighbours of a few queries in each run of rows, with the distances of their codes."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array([v for _, v in tried])
        asked_codes = codes.of(asked, True)
        for batch in batches:
            vectors, ids = blocks.matrix(batch["vector"], codes.width()), batch["vec_id"].to_numpy()
            own = codes.of(vectors)
            scores = vectors @ asked.T
            for j, (q, _) in enumerate(tried):
                others = np.flatnonzero(ids != q)
                top = others[first_of(ids[others], scores[others, j], k)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([q] * len(top), pa.int64()), "score": pa.array(scores[top, j], pa.float64()),
                    "apart": pa.array(distances(asked_codes[j], own[top]).astype(np.int32), pa.int32())})

    return nearest


def learn(rows: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, tried: int = TRIED, share: float = SHARE) -> tuple[Codes, int]:
    """Codes and radius: the rotation from ``sample`` rows, the radius from all rows near ``tried`` queries.

    Both samples are drawn by hash of the id and bounded, as is what reaches the driver:
    ``sample`` vectors, and k numbers for each of the ``tried`` queries.
    """
    def drawn(df: DataFrame, n: int) -> list:
        return df.orderBy(F.xxhash64(F.lit("drawn"), "vec_id"), "vec_id").limit(n).select("vec_id", "vector").collect()

    longest, width = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))), F.max(F.size("vector"))).first()

    def padded(found: list) -> np.ndarray:
        return np.array([list(r["vector"]) + [0.0] * (width - len(r["vector"])) for r in found])

    codes = learn_codes(padded(drawn(rows, sample)), longest)
    asked = drawn(queries, tried)
    trial = [(r["vec_id"], v) for r, v in zip(asked, padded(asked).tolist(), strict=True)] if asked else []
    if not trial:
        return codes, BITS
    near = rows.mapInArrow(_nearest_of(trial, codes, k), "query_id bigint, score double, apart int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "apart"))
    apart = near.withColumn("rank", rank).filter(F.col("rank") <= k).agg(F.percentile("apart", share)).first()[0]
    return codes, BITS if apart is None else min(BITS, int(np.ceil(apart)) + MARGIN)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, **learning) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    ``rows`` and ``queries``: (vec_id, vector) as ``usable_vectors`` gives them, with unique
    ids. A row of the query's own id is no candidate. Ties go to the smaller id; with fewer
    than k candidates all are returned. Every row is indexed; shorter vectors count as
    ending in zeros. No rows or no queries give no result.
    """
    scratch = Scratch(rows.sparkSession)
    rows, queries = scratch.store(rows, "vectors"), scratch.store(queries, "queries")
    n, m = rows.count(), queries.count()
    if not n or not m:
        empty = "query_id bigint, rank int, vec_id bigint, score double"
        return rows.sparkSession.createDataFrame([], empty)
    codes, radius = learn(rows, queries, k, **learning)
    found = blocks.paired(queries, rows, "vec_id", m, n).applyInArrow(_search(codes, radius, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of (vec_id, embedding) as doubles, one row per id.

    Vectors that are null, empty or zero, or hold a null or a component that is not
    finite, take no part, nor do rows without an id. Of rows that repeat an id the
    smallest vector stays.
    """
    filled = blocks.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(filled).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                         F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return blocks.one_row_each(rows, "vec_id")
