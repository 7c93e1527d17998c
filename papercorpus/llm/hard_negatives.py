"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors are whole numbers and a row's score is its inner product with the anchor. Rows are
dealt into blocks; in each, every dimension keeps its rows sorted by value. For an anchor
the lists are read from the end that its sign favours, some rows of every list at a time;
each row met is scored at once from its whole vector (random access). No row still unmet
can score above the threshold, the sum of the products with the values last read. Reading
stops once the threshold is strictly below the k-th score found in each of the anchor's
score windows, or below the window itself, so that ties are all met. The best of each
block are merged.

Two passes: the positives of the anchors first, as their scores set the windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .scratch import Scratch

#: Rows read from every list by the end of each round; then the whole lists.
DEPTHS = (16, 64, 256, 1024)
SCALE, K, LOW, HIGH = 256, 5, 80, 100


class Lists:
    """A block's rows with the sorted list of each dimension, from either end."""

    def __init__(self, vectors: np.ndarray):
        exact = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2**52
        self.vectors = vectors.astype(np.float64) if exact else vectors  # doubles hold these sums exactly, and multiply faster
        up = np.argsort(vectors, axis=0, kind="stable").T
        self.rows = np.stack([up, up[:, ::-1]])
        self.values = np.take_along_axis(np.broadcast_to(self.vectors.T, (2, *up.shape)), self.rows, 2)

    def rounds(self, anchor: np.ndarray):
        """(row numbers newly met, their scores, threshold) round by round; the last threshold is None."""
        n = len(self.vectors)
        anchor = anchor.astype(self.vectors.dtype)
        dims = np.flatnonzero(anchor)
        end = (anchor[dims] > 0).astype(np.int64)
        unseen, start = np.ones(n, bool), 0
        for depth in [*(d for d in DEPTHS if d < n), n]:
            met = np.zeros(n, bool)
            if depth < n and len(dims):
                met[self.rows[end, dims, start:depth]] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & unseen)
            unseen[new] = False
            whole = depth == n or not unseen.any()
            threshold = None if whole else int(anchor[dims] @ self.values[end, dims, depth - 1])
            yield new, (self.vectors[new] @ anchor).astype(np.int64), threshold
            if whole:
                return
            start = depth


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by higher score, then smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def top_in_windows(lists: Lists, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, windows: list[tuple[int | None, int | None]],
                   k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the first k allowed rows with 100 * score in each window (low, high), None for no bound."""
    met, scored = [], []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for new, scores, threshold in lists.rounds(anchor):
        use = allowed[new]
        met.append(new[use])
        scored.append(scores[use])
        rows, points = np.concatenate(met), np.concatenate(scored)
        held, done = [], True
        for low, high in windows:
            inside = np.ones(len(points), bool)
            if low is not None:
                inside &= 100 * points >= low
            if high is not None:
                inside &= 100 * points <= high
            of = np.flatnonzero(inside)
            first = of[best(points[of], ids[rows[of]], k)]
            held.append((ids[rows[first]], points[first]))
            if threshold is not None:
                full = len(first) == k and threshold < points[first[-1]]
                done &= full or low is not None and 100 * threshold < low
        if done:
            break
    return held


def _positives(k: int):
    def positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = blocks.width_of(anchors["vector"], rows["vector"])
        lists = Lists(blocks.matrix(rows["vector"], width, np.int64))
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        out: list[tuple] = []
        for a, label, vector in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(),
                                    blocks.matrix(anchors["vector"], width, np.int64), strict=True):
            found = top_in_windows(lists, ids, (labels == label) & (ids != a), vector, [(None, None)], k)[0] if len(ids) else ((), ())
            out += [(a, int(i), int(s)) for i, s in zip(*found, strict=True)]
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    return positives


def _negatives(k: int, low: int, high: int):
    def negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = blocks.width_of(anchors["vector"], rows["vector"])
        lists = Lists(blocks.matrix(rows["vector"], width, np.int64))
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        out: list[tuple] = []
        for a, label, scores, vector in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["scores"].to_pylist(),
                                            blocks.matrix(anchors["vector"], width, np.int64), strict=True):
            if len(ids):
                windows = [(low * s, high * s) for s in scores]
                for s, found in zip(scores, top_in_windows(lists, ids, labels != label, vector, windows, k), strict=True):
                    out += [(a, s, int(i), int(x)) for i, x in zip(*found, strict=True)]
        return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return negatives


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _first(found: DataFrame, by: list[str], score: str, of: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), of)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor.

    ``rows`` and ``anchors``: (vec_id, label, vector) with unique ids and whole-number
    vectors; anchors are rows too. Positives are the first ``k`` other rows of the anchor's
    label by higher score, then smaller id; for each, the first ``k`` rows of other labels
    with ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score are
    returned. So a negative positive_score has none. Shorter vectors count as ending in
    zeros; sums beyond 64 bits wrap. No rows, no anchors or one label give no result.
    """
    scratch = Scratch(rows.sparkSession)
    rows, anchors = scratch.store(rows.select("vec_id", "label", "vector"), "vectors"), scratch.store(
        anchors.select("vec_id", "label", "vector"), "anchors")
    n, m = rows.count(), anchors.count()
    near = blocks.paired(anchors, rows, "vec_id", m, n).applyInArrow(_positives(k), "anchor_id bigint, positive_id bigint, positive_score bigint")
    positives = scratch.store(_first(near, ["anchor_id"], "positive_score", "positive_id", k).drop("rank"), "positives")
    scores = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    asking = scratch.store(anchors.join(scores, "vec_id"), "windows")
    far = blocks.paired(asking, rows, "vec_id", m, n).applyInArrow(
        _negatives(k, low, high), "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    negatives = scratch.store(_first(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", k), "negatives")
    scratch.drop(rows, anchors, asking)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the usable rows of (vec_id, embedding, label): floor(scale * x) of every component.

    Rows with a null id, label or vector, an empty vector, or a component that is null or
    not finite take no part. Of rows that repeat an id the smallest by label and vector stays.
    """
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.filter(blocks.usable(F.col("embedding")) & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), vector.alias("vector"))
    return blocks.one_row_each(rows, "vec_id")
