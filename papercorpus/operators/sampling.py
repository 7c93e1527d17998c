"""Exact seeded cuts: splits and samples that do not depend on partitioning.

Rows are ordered by a seeded hash of a unique key.  Instead of ranking all rows,
only the *cut point* of each stratum is looked for, the key of the last row that
still belongs to its first ``quota`` rows:

1. count rows per stratum and hash prefix (pre-aggregated, so a hot stratum is
   no hot task);
2. running counts over the prefixes tell in which prefix the cut lies;
3. only the rows of that one prefix are ranked (1 in 65,536 of a stratum).

Membership is then a comparison with the cut point, so the wide rows are
filtered or labelled where they are.  They are shuffled only where the cut points of
the strata are too many to be broadcast.  The narrow columns are
read twice per cut, so large inputs should be stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

NA_STRATUM = "__NA__"  # fixed value: stratum of rows without one
PREFIX_DIGITS = 4
AFTER_ALL = "~"  # sorts behind every hex digit
NOT_UNIQUE = "the key is not unique: rows tie at a cut"


class Cut(NamedTuple):
    """Rows of a group and stratum up to its point: (group, stratum, point) in ``points``."""

    group: Column
    stratum: Column
    order: Column
    points: DataFrame


def stratum_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NA_STRATUM))


def stratum_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(stratum_of(column).alias("stratum")).agg(F.count("*").alias("size"))


def stratify_gate(strata: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each ``by`` group): number of strata, rows, and whether the strata can be kept."""
    kept = (F.count("*") >= 2) & (F.min("size") >= 2)
    return strata.groupBy(*by).agg(
        F.count("*").alias("strata"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
        kept.alias("stratify"),
    )


def seeded_order(seed: int, salt: str, key: Column) -> Column:
    """Order key: seeded hash, then the key itself.  A null key is an error."""
    text = F.coalesce(key.cast("string"), F.raise_error(F.lit("null key: rows cannot be put in order")))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), text)), F.lit(":"), text)


def default_key(df: DataFrame) -> Column:
    """The ``row_key`` made by ``prepare`` if it is there, or else the id."""
    for name in ("row_key", "id"):
        if name in df.columns:
            return F.col(name)
    raise ValueError("no row_key or id column: name a unique key")


def stratum_quotas(
    strata: DataFrame, draws: int | Column, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Share ``draws`` rows out in proportion to the stratum sizes, in each ``by`` group.

    Every stratum gets the floor of its share; the rest go to the largest
    remainders, ties in seeded order.  Shares are whole-number arithmetic, and
    depend on the size only, so the remainders are settled on a table with one
    row per *distinct size* (at most sqrt(2 * rows) of them), whatever the
    number of strata.  ``draws`` is a number, or a column with one value per group.
    """
    by = list(by)
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    wide = "decimal(19,0)"
    strata = strata.withColumn("draws", F.lit(draws) if isinstance(draws, int) else draws)
    product = F.col("size").cast(wide) * F.col("draws").cast(wide)
    by_remainder = everything.orderBy(F.desc("remainder"), F.desc("size"))
    sizes = (
        strata.groupBy(*by, "size", "draws")
        .agg(F.count("*").alias("members"))
        .withColumn("total", F.sum(F.col("size") * F.col("members")).over(everything))
        .withColumn("base", F.floor(product / F.col("total")).cast("long"))
        .withColumn("remainder", product - F.col("base").cast(wide) * F.col("total").cast(wide))
        .withColumn("extra", F.col("draws") - F.sum(F.col("base") * F.col("members")).over(everything))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("members").over(by_remainder.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .withColumn("bonus", F.greatest(F.lit(0), F.least("members", F.col("extra") - F.col("before"))))
        .select(*by, "size", "base", "members", "bonus")
    )
    shares = strata.select(*by, "stratum", "size").join(sizes, [*by, "size"])
    settled = shares.filter("bonus = 0 or bonus = members").select(
        *by, "stratum", "size", (F.col("base") + (F.col("bonus") > 0).cast("long")).alias("quota")
    )
    # at most one size of a group gets a bonus for some of its strata only
    tie = seeded_order(seed, "tie", F.col("stratum"))
    contested = shares.filter("bonus > 0 and bonus < members").withColumn("prefix", _prefix(tie))
    before = Window.partitionBy(*by, "size").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        contested.groupBy(*by, "size", "prefix")
        .agg(F.count("*").alias("n"))
        .select(*by, "size", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    place = F.col("offset") + F.row_number().over(Window.partitionBy(*by, "size", "prefix").orderBy(tie))
    ranked = (
        contested.join(offsets, [*by, "size", "prefix"])
        .withColumn("place", place)
        .select(
            *by, "stratum", "size",
            (F.col("base") + (F.col("place") <= F.col("bonus")).cast("long")).alias("quota"),
        )
    )
    return settled.unionByName(ranked)


def _prefix(order: Column) -> Column:
    return F.substring(order, 1, PREFIX_DIGITS)


CELL = ["group", "stratum"]


def _histogram(rows: DataFrame) -> DataFrame:
    """Rows per group, stratum and hash prefix, stored: gates, quotas and cuts read it."""
    counts = rows.groupBy(*CELL, _prefix(F.col("order")).alias("prefix")).agg(
        F.count("*").alias("n")
    )
    return stored(counts, "histogram")


def _cut_points(rows: DataFrame, histogram: DataFrame, quotas: DataFrame, ties: bool = False) -> DataFrame:
    """(group, stratum, point): the cut point of every group and stratum.

    Rows that tie at a cut are an error, or with ``ties`` counted: ``keep`` is the number of them
    before the cut (null where only one row stands at the point).
    """
    earlier = Window.partitionBy(*CELL).orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, -1
    )
    running = histogram.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    edges = stored(
        running.join(quotas, CELL).filter(
            (F.col("before") < F.greatest("quota", F.lit(1)))
            & (F.greatest("quota", F.lit(1)) <= F.col("before") + F.col("n"))
        ),
        "edges",
    )
    contested = edges.filter("quota > 0 and quota < size").select(
        *CELL, "prefix", (F.col("quota") - F.col("before")).alias("take")
    )
    inside = rows.withColumn("prefix", _prefix(F.col("order"))).join(
        contested, [*CELL, "prefix"]
    )
    ranks = Window.partitionBy(*CELL).orderBy("order")
    at_cut = (
        inside.withColumns({"place": F.row_number().over(ranks), "rank": F.rank().over(ranks),
                            "next": F.lead("order").over(ranks)})
        .filter("place = take")
    )
    tied = F.col("next") == F.col("order")
    order = F.col("order") if ties else F.when(tied, F.raise_error(F.lit(NOT_UNIQUE))).otherwise(F.col("order"))
    keep = [F.when(tied, F.col("place") - F.col("rank") + 1).alias("keep")] if ties else []
    last = at_cut.select(*CELL, order.alias("last"), *keep)
    point = (
        F.when(F.col("quota") == 0, F.lit(""))
        .when(F.col("quota") == F.col("size"), F.lit(AFTER_ALL))
        .otherwise(F.col("last"))
    )
    return edges.join(last, CELL, "left").select(*CELL, point.alias("point"), *(["keep"] if ties else []))


def _sizes(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy(*CELL).agg(F.sum("n").alias("size"))


def _keys(by: str | None, stratum: str | None) -> tuple[Column, Column]:
    return tuple(F.lit("") if c is None else stratum_of(c) for c in (by, stratum))


def fraction_cut(
    df: DataFrame, fraction: float, seed: int, salt: str, key: Column, stratify: str | None,
    by: str | None = None,
) -> Cut:
    """Cut off the first floor(fraction * rows) of each ``by`` group, stratified where its gate allows it.

    Gates are part of the plan: they are aggregates of the histogram, joined back
    to the strata.  The strata of a group whose gate is closed are cut as one.
    """
    order = seeded_order(seed, salt, key)
    group, column = _keys(by, stratify if stratify in df.columns else None)
    rows = df.select(group.alias("group"), column.alias("stratum"), order.alias("order"))
    histogram = _histogram(rows)
    sizes = _sizes(histogram)
    draws = F.floor(F.lit(float(fraction)) * F.col("total")).cast("long")
    gated = stored(sizes.join(stratify_gate(sizes, ["group"]).withColumn("draws", draws), "group"), "gates")

    # the cell that is cut on its own: a stratum, or the whole group (null)
    cell = F.when(F.col("stratify"), F.concat(F.lit("="), F.col("stratum"))).otherwise(F.lit(""))
    cells = gated.withColumn("cell", cell).select(*CELL, "cell")
    whole = gated.filter("not stratify").select(
        "group", F.lit("").alias("stratum"), F.col("total").alias("size"), F.col("draws").alias("quota")).distinct()
    split = stratum_quotas(gated.filter("stratify"), F.col("draws"), seed, ["group"]).select(
        "group", F.concat(F.lit("="), "stratum").alias("stratum"), "size", "quota")

    def as_cells(table: DataFrame) -> DataFrame:
        return table.join(cells, CELL).drop("stratum").withColumnRenamed("cell", "stratum")

    merged = as_cells(histogram).groupBy(*CELL, "prefix").agg(F.sum("n").alias("n"))
    points = _cut_points(as_cells(rows), merged, whole.unionByName(split))
    of_strata = cells.join(points.withColumnRenamed("stratum", "cell"), ["group", "cell"]).select(*CELL, "point")
    return Cut(group, column, order, stored(of_strata, "points"))


def label_cut(df: DataFrame, cut: Cut, name: str) -> DataFrame:
    """Add a boolean column telling which rows lie before the cut."""
    points = cut.points.select(
        F.col("group").alias("_group"), F.col("stratum").alias("_stratum"), F.col("point").alias("_point"))
    joined = df.join(points, (cut.group == F.col("_group")) & (cut.stratum == F.col("_stratum")), "left")
    inside = F.coalesce(cut.order <= F.col("_point"), F.lit(False))
    return joined.withColumn(name, inside).drop("_group", "_stratum", "_point")


def check_fractions(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"split fractions must sum to 1, got {train + val + test:.6f}")


def split_rows(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    key: Column | None = None,
    stratify: str | None = "primary_topic",
    by: str | None = None,
) -> DataFrame:
    """Add a ``split`` column: train against the rest, then val against test.

    Sizes and stratum quotas are exact, in each ``by`` group where one is named (many
    tables in one job).  The stratification gate of a group is tested again
    on its rest.  ``key`` (default: row_key, or else id) must be unique: a null key
    and rows that tie at a cut are errors.  Finding the cut points runs a few jobs
    over the narrow columns; the labelling itself is lazy.
    """
    check_fractions(train, val, test)
    key = default_key(df) if key is None else key
    first = fraction_cut(df, train, seed, "train", key, stratify, by)
    labelled = label_cut(df, first, "_train")
    rest = labelled.filter(~F.col("_train"))
    second = fraction_cut(rest, val / (val + test), seed, "val", key, stratify, by)
    split = F.when(F.col("_train"), "train").when(F.col("_val"), "val").otherwise("test")
    return label_cut(labelled, second, "_val").withColumn("split", split).drop("_train", "_val")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split and, as ``full``, of the whole table."""
    return df.rollup("split").agg(F.count("*").alias("rows")).select(
        F.coalesce("split", F.lit("full")).alias("split"), "rows"
    )


def sample_rows(
    df: DataFrame, n: int, seed: int, salt: str, key: Column, by: str | None = None
) -> DataFrame:
    """Seeded sample of min(n, rows) rows, of each ``by`` group if given.

    The cut point of every group is found on narrow columns, for any ``n`` in the
    same way, and the rows are filtered where they are.  ``key`` must be unique, as
    for ``split_rows``, but for rows that are equal in all columns: where such rows tie at
    a cut it does not matter which are taken, and as many as are needed are.
    """
    order = seeded_order(seed, salt, key)
    if n <= 0:
        return df.limit(0)
    group, stratum = _keys(by, None)
    rows = df.select(group.alias("group"), stratum.alias("stratum"), order.alias("order"))
    histogram = _histogram(rows)
    quotas = _sizes(histogram).withColumn("quota", F.least("size", F.lit(n).cast("long")))
    points = stored(_cut_points(rows, histogram, quotas, ties=True), "points")
    sample = label_cut(df, Cut(group, stratum, order, points), "_in").filter("_in").drop("_in")
    tied = points.filter("keep is not null").select(F.col("group").alias("_group"), F.col("point").alias("_point"), "keep")
    return sample if tied.isEmpty() else _with_ties_cut(sample, tied, group, order)


def _with_ties_cut(sample: DataFrame, tied: DataFrame, group: Column, order: Column) -> DataFrame:
    """``sample`` with ``keep`` of the rows at each point in ``tied``; these must be equal in all columns."""
    at_point = (group == F.col("_group")) & (order == F.col("_point"))
    row = F.struct(*sample.columns)
    # one row a group, merged before the shuffle however many rows tie
    ends = stored(sample.join(tied, at_point).groupBy("_group", "keep").agg(
        F.first(row).alias("row"), F.min(F.to_json(row)).alias("low"), F.max(F.to_json(row)).alias("high")), "ties")
    if not ends.filter("low <> high").isEmpty():
        raise ValueError(NOT_UNIQUE)
    copies = ends.select("row", F.explode(F.sequence(F.lit(1), F.col("keep"))).alias("_copy")).select("row.*")
    return sample.join(tied, at_point, "left_anti").unionByName(copies)


def evaluation_cap(df: DataFrame, max_rows: int, seed: int, key: Column) -> DataFrame:
    """At most ``max_rows`` rows per split, seeded; 0 keeps all."""
    return df if max_rows <= 0 else sample_rows(df, max_rows, seed, "eval", key, by="split")
