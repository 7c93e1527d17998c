"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces come longest first; each goes to the open
bin with the least room that holds it. Where none does, a new bin opens in the length
whose cost per token is least, counting the smaller pieces still to come that could fill
it. At the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .scratch import Scratch

CAPACITIES = (256, 512, 1024, 2048)
#: Cost of a bin: its capacity and so many tokens for having one more sequence.
OVERHEAD = 32
GROUP = 4096


def best_fit(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (all positive, none above the largest capacity), capacity of each bin."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rising = [lengths[i] for i in reversed(order)]
    before = np.concatenate([[0], np.cumsum(rising)]).tolist()  # tokens of the so many smallest
    bins, offsets, used, opened = [0] * len(lengths), [0] * len(lengths), [], []
    rooms: list[tuple[int, int]] = []  # (room, bin), in order
    for done, i in enumerate(order):
        size, left = lengths[i], len(order) - done - 1
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            def price(c: int, size=size, left=left) -> tuple[float, int]:
                fill = before[min(left, bisect_left(rising, c - size + 1))]
                return (c + overhead) / (size + min(c - size, fill)), c

            room = min((c for c in sizes if c >= size), key=price)
            b = len(used)
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used]


def pack(docs: DataFrame, length: Column | None = None, capacities=CAPACITIES, overhead: int = OVERHEAD,
         group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, bin, capacity, place) of every piece of every row of ``docs``.

    ``length``: tokens of a row, by default its words. Rows longer than the largest
    capacity are cut into pieces of that size, each a full bin, and a rest. ``start`` is
    the piece's first token in the row, ``place`` its offset in the bin. Rows without
    tokens (null or empty texts) give one piece of length 0 in no bin. Rows that repeat a
    doc_id are packed each for itself. Pieces are dealt by a hash of the row's number
    into groups of about ``group`` and packed within them, so no task grows with the corpus.
    """
    scratch = Scratch(docs.sparkSession)
    most = max(capacities)
    tokens = F.coalesce(length if length is not None else n_words(), F.lit(0)).cast("long")
    rows = scratch.store(docs.select("doc_id", tokens.alias("tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    groups = max(1, -(-rows.count() // group))
    pieces = rows.select("doc_id", "row", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / most))).alias("piece"), "tokens").select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.lit(most), F.col("tokens") - F.col("piece") * most).alias("length"),
        F.pmod(F.xxhash64("row"), F.lit(groups)).alias("lot"), "row")
    schema = "doc_id bigint, piece bigint, start bigint, length bigint, bin string, capacity bigint, place bigint"

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes, lot = table.column("length").to_pylist(), table.column("lot")[0].as_py()
        bins, offsets, held = best_fit(sizes, capacities, overhead)
        return table.select(["doc_id", "piece", "start", "length"]).append_column(
            "bin", pa.array([f"{lot}-{b}" for b in bins])).append_column(
            "capacity", pa.array([held[b] for b in bins], pa.int64())).append_column("place", pa.array(offsets, pa.int64()))

    rest = pieces.filter((F.col("length") > 0) & (F.col("length") < most)).groupBy("lot").applyInArrow(packed, schema)
    own = pieces.filter((F.col("length") == 0) | (F.col("length") == most))
    full = F.col("length") > 0
    return rest.unionByName(own.select(
        "doc_id", "piece", "start", "length",
        F.when(full, F.concat_ws("-", F.lit("full"), "row", "piece")).alias("bin"),
        F.when(full, F.lit(most).cast("long")).alias("capacity"), F.when(full, F.lit(0).cast("long")).alias("place")))
