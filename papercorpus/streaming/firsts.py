"""The first arrival of every key in a stream, with state that the watermark clears."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shared import ship_package


def _first_rows(table: pa.Table, key: str, order: Sequence[str]) -> pa.Table:
    """The first row of each key by the order columns."""
    place = pc.sort_indices(table.select([key, *order]), sort_keys=[(c, "ascending") for c in (key, *order)])
    keys = table[key].take(place).to_numpy(zero_copy_only=False)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return table.take(place.filter(pa.array(fresh)))


def _of_batches(key: str, order: Sequence[str]):
    """First rows of every Arrow batch: merges a frequent key before the shuffle."""
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _first_rows(pa.Table.from_batches([batch]), key, order).to_batches()

    return firsts


def _of_partition(key: str, order: Sequence[str]):
    """First rows of a whole partition; holds one row per key, and less than as many again."""
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows > max(100_000, 0 if held is None else held.num_rows):
                held = _first_rows(pa.concat_tables([*([] if held is None else [held]), pa.Table.from_batches(waiting)]), key, order)
                waiting, rows = [], 0
        if waiting:
            held = _first_rows(pa.concat_tables([*([] if held is None else [held]), pa.Table.from_batches(waiting)]), key, order)
        if held is not None:
            yield from held.to_batches()

    return firsts


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str, order: Sequence[str] = ()) -> DataFrame:
    """The first row of every non-empty ``key``, as rows keep arriving.

    Within a micro-batch the first is the one with the smallest ``time`` and ``order``
    columns; over batches it is the one that came first. Keys are remembered until the
    watermark (latest time seen less ``delay``) is ``delay`` past the time of their first row, and
    rows older than the watermark are dropped: repeats closer than that never pass, and
    state does not grow with the age of the stream. A frequent key is merged per Arrow
    batch before the shuffle. With files landing in order, and repeats within the delay,
    the result is that of ``keep_first`` over the whole table.
    """
    ship_package(stream.sparkSession)
    by = [time, *order]
    keyed = stream.filter(stream[key].isNotNull() & (stream[key].cast("string") != "") & stream[time].isNotNull())
    merged = keyed.mapInArrow(_of_batches(key, by), stream.schema)
    single = merged.repartition(key).mapInArrow(_of_partition(key, by), stream.schema)
    return single.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
