"""Vector expressions.  Inputs are float arrays; sums are kept in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MIN_NORM = 1e-12  # fixed value: lower bound of a norm
MIN_COUNT = 1e-9  # fixed value: lower bound of a mask sum


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.greatest(F.sqrt(dot(vector, vector)), F.lit(MIN_NORM))


def l2_normalise(vector: Column) -> Column:
    return let(
        norm(vector), lambda length: F.transform(vector, lambda x: x.cast("double") / length)
    )


def cosine(left: Column, right: Column) -> Column:
    """Dot product of the two vectors after L2 normalisation."""
    return dot(left, right) / (norm(left) * norm(right))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set."""
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    nothing = F.array().cast("array<double>")
    total = F.aggregate(weighted, nothing, lambda sums, v: F.zip_with(sums, v, lambda s, x: F.coalesce(s, F.lit(0.0)) + x))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda n, m: n + m), F.lit(MIN_COUNT))
    return let(count, lambda n: F.transform(total, lambda x: x / n))


def _shapes(column: pa.ListArray) -> np.ndarray:
    """(tokens, width) of the token vectors of each row; -1 tokens for a missing row."""
    tokens = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    widths = pc.fill_null(pc.list_value_length(pc.list_flatten(column)), 0).to_numpy()
    first = np.concatenate([[0], np.cumsum(np.maximum(tokens, 0))[:-1]])
    width = np.zeros(len(tokens), np.int64)
    filled = tokens > 0
    width[filled] = widths[first[filled]]
    return np.stack([tokens, width], 1)


def _stack(column: pa.ListArray, rows: np.ndarray, *shape: int) -> np.ndarray:
    """The values of some rows, all of one shape, as one array."""
    part = column.take(pa.array(rows))
    while pa.types.is_list(part.type):
        part = pc.list_flatten(part)
    return part.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), *shape)


def _best_matches(p: np.ndarray, r: np.ndarray, p_weight: np.ndarray, r_weight: np.ndarray) -> np.ndarray:
    """(rows, 3): precision, recall and f1 of rows with as many tokens on each side."""
    units = [v / np.maximum(np.linalg.norm(v, axis=2, keepdims=True), MIN_NORM) for v in (p, r)]
    similarity = units[0] @ units[1].transpose(0, 2, 1)
    precision = (similarity.max(2) * p_weight).sum(1) / np.maximum(p_weight.sum(1), MIN_COUNT)
    recall = (similarity.max(1) * r_weight).sum(1) / np.maximum(r_weight.sum(1), MIN_COUNT)
    total = precision + recall
    f1 = np.divide(2 * precision * recall, total, out=np.zeros_like(total), where=total != 0)
    return np.stack([precision, recall, f1], 1)


def _match_batch(p: pa.Array, r: pa.Array, pw: pa.Array, rw: pa.Array, most: int = 1 << 20) -> pa.Array:
    """Rows of one shape are matched together, as many at a time as ``most`` similarities hold."""
    shapes = np.concatenate([_shapes(p), _shapes(r)], 1)
    found = np.zeros((len(p), 3))
    kinds, kind_of = np.unique(shapes, axis=0, return_inverse=True)
    for k, (n, width, m, _) in enumerate(kinds.tolist()):
        if n <= 0 or m <= 0 or not width:
            continue
        rows = np.flatnonzero(kind_of.ravel() == k)
        step = max(1, most // (n * m + (n + m) * width))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            found[some] = _best_matches(_stack(p, some, n, width), _stack(r, some, m, width),
                                        _stack(pw, some, n), _stack(rw, some, m))
    missing = (shapes[:, 0] < 0) | (shapes[:, 2] < 0)
    return pa.StructArray.from_arrays([pa.array(c) for c in found.T], names=["precision", "recall", "f1"], mask=pa.array(missing))


def greedy_match(
    prediction: Column,
    reference: Column,
    prediction_weight: Column | None = None,
    reference_weight: Column | None = None,
) -> Column:
    """Greedy max-cosine matching of token vectors: struct(precision, recall, f1).

    A weight of 0 keeps a token (a sentence marker, say) out of the means while
    it can still be matched.  A missing side gives null.
    """

    def ones(vectors: Column) -> Column:
        return F.array_repeat(F.lit(1.0), F.size(vectors))

    @F.arrow_udf("struct<precision:double,recall:double,f1:double>")
    def match(p: pa.Array, r: pa.Array, pw: pa.Array, rw: pa.Array) -> pa.Array:
        return _match_batch(p, r, pw, rw)

    weights = (
        ones(prediction) if prediction_weight is None else prediction_weight.cast("array<double>"),
        ones(reference) if reference_weight is None else reference_weight.cast("array<double>"),
    )
    return match(prediction, reference, *weights)
