"""Counts of arrivals by event time, for rows that keep arriving and may be late.

A window is handed on once, when the watermark (the latest time seen less the allowed
delay) has passed its end; rows that come later than that are dropped. State holds the
open windows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(rows: DataFrame, frame: Column, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    counts = rows.groupBy(frame.alias("_frame"), *by).agg(
        F.count("*").alias("rows"), *(m.alias(name) for name, m in measures.items()))
    return counts.select(F.col("_frame.start").alias("start"), F.col("_frame.end").alias("end"), *by, "rows", *measures)


def count_windows(rows: DataFrame, time: str, width: str, delay: str, by: Sequence[str] = (), slide: str | None = None,
                  **measures: Column) -> DataFrame:
    """(start, end, by..., rows, measures...) of windows of ``width``, beginning every ``slide`` (default: width).

    ``rows`` may be a stream or a table; on a table every window is returned and ``delay``
    means nothing. Counts are merged before the shuffle. Rows without a time are in no window.
    """
    late = rows.withWatermark(time, delay)
    return _counted(late, F.window(time, width, slide), by, measures)


def count_sessions(rows: DataFrame, time: str, gap: str, delay: str, by: Sequence[str], **measures: Column) -> DataFrame:
    """(start, end, by..., rows, measures...) of sessions: rows of a ``by`` group less than ``gap`` apart.

    ``end`` is the last row's time and the gap. Needs a ``by`` column on a stream. Rows
    without a time are in no session.
    """
    late = rows.withWatermark(time, delay)
    return _counted(late, F.session_window(time, gap), by, measures)
