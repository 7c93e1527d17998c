"""Select and normalise raw works that have landed as files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.works import (
    display_names, primary_name, rebuild_abstract, short_id, work_title,
)
from ..sources.shared import stored
from .cleaning import keep_first


def works_predicate(
    from_date: date | str | None = None,
    to_date: date | str | None = None,
    topic_ids: Sequence[str] = (),
    concept_ids: Sequence[str] = (),
) -> Column:
    """All given conditions together; ids are alternatives; empty parts are skipped."""

    def any_id(column: str, ids: Sequence[str]) -> Column:
        return F.exists(column, lambda entry: short_id(entry["id"]).isin(list(ids)))

    condition = F.lit(True)
    if from_date:
        condition &= F.col("publication_date") >= F.lit(from_date).cast("date")
    if to_date:
        condition &= F.col("publication_date") <= F.lit(to_date).cast("date")
    if topic_ids:
        condition &= any_id("topics", topic_ids)
    if concept_ids:
        condition &= any_id("concepts", concept_ids)
    return condition


def filter_text(
    from_date: str | None = None, to_date: str | None = None,
    topic_ids: Sequence[str] = (), concept_ids: Sequence[str] = (),
) -> str:
    """The same selection as text, as kept in the collection record."""
    # fixed values: names of the filter parts
    parts = {
        "from_publication_date": from_date,
        "to_publication_date": to_date,
        "topics.id": "|".join(topic_ids),
        "concepts.id": "|".join(concept_ids),
    }
    return ",".join(f"{name}:{value}" for name, value in parts.items() if value)


def with_id(works: DataFrame) -> DataFrame:
    return works.filter(F.col("id") != "")


def first_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` rows by ``seq``, which must be unique and not null.

    The narrow order column is dealt into ranges and stored; counts of the ranges tell in
    which one the n-th row lies, and only that range is ranked. The rows are then
    compared with the n-th one's order where they are, so no task gathers ``n`` rows.
    """
    if n <= 0:
        return df.limit(0)
    ranges = stored(df.select(F.col(seq).alias("at")).repartitionByRange("at").withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranges.groupBy("range").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    edge = sizes.filter((F.col("before") < n) & (F.col("before") + F.col("rows") >= n)).select("range", "before")
    ranked = ranges.join(edge, "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("at")))
    last = stored(ranked.filter(F.col("place") + F.col("before") == n).select("at"), "last-row")
    return df.filter(F.coalesce(F.col(seq) <= last.scalar(), F.lit(True)))  # no n-th row: all of them


def cap_and_deduplicate(
    works: DataFrame, max_results: int | None = None, seq: str = "seq"
) -> DataFrame:
    """First ``max_results`` works in order, then the first per non-empty id.

    The cap comes first, so fewer works may remain.
    """
    if max_results is not None:
        works = first_rows(works, max_results, seq)
    return keep_first(with_id(works), ["id"], seq)


def normalise_works(
    works: DataFrame, keep_empty: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Nested works as flat papers; works without abstract are dropped by default.

    The drop sits in a generator over the rebuilt text, which is thus made once
    per row (a filter over a projection would be pushed below it and rebuild).
    """
    abstract = F.coalesce(rebuild_abstract(F.col("abstract_inverted_index")), F.lit(""))
    texts = F.filter(F.array(abstract), lambda text: F.lit(keep_empty) | (text != ""))
    return works.select(
        short_id(F.col("id")).alias("id"),
        work_title(F.col("title"), F.col("display_name")).alias("title"),
        F.explode(texts).alias("abstract"),
        "publication_year",
        display_names(F.col("topics")).alias("topics"),
        primary_name(F.col("topics")).alias("primary_topic"),
        *carry,
    )
