"""Blocks of vectors: rows and askers dealt into blocks of bounded size, every pair of blocks one task's work.

A stated set of askers against all rows. Both sides are dealt by hash, so one frequent
vector, label or group of copies spreads over all blocks; the number of blocks follows
the number of rows, and a task holds one block of each side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, ASKERS = 4096, 2048


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``key``, the smallest by the other columns; rows without a key go."""
    others = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")


def paired(askers: DataFrame, rows: DataFrame, key: str, n_askers: int, n_rows: int):
    """``askers`` and ``rows``, cogrouped so that each block of one meets each block of the other once."""
    asker_blocks, row_blocks = max(1, -(-n_askers // ASKERS)), max(1, -(-n_rows // ROWS))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(own), F.col(key)), F.lit(count)).cast("int").alias(own)
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(askers, "asker_block", asker_blocks, "row_block", row_blocks)
    right = dealt(rows, "row_block", row_blocks, "asker_block", asker_blocks)
    return left.groupBy("asker_block", "row_block").cogroup(right.groupBy("asker_block", "row_block"))


def matrix(column: pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """Lists of numbers as rows of ``width``; shorter ones end in zeros."""
    if len(column) == 0:
        return np.zeros((0, width), kind)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    """Length of the longest list."""
    return max([1, *(int(np.diff(c.combine_chunks().offsets.to_numpy()).max()) for c in columns if len(c))])
