"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Targets: the sources share a total by weight; a source whose share is above its limit
gets the limit, and the excess is shared again. Documents are dealt to cells (source and
shard), and a source's blocks of equal tokens are apportioned to its cells by the highest
quotients size / (2k + 1), so that every cell has a whole number of blocks. In a cell the
documents stand in seeded order, end to end, as a ring; its quota is read off the ring
from the start, more than once round where the target is above the size. So the seed
decides which blocks a quota takes: those that come first in a cell's seeded order.

Shards grow with the corpus, so no window or task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, spare

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK, SHARD_DOCS, SEED = 64, 20_000, 42


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Weights repeat over the sources by code point, null last. The level at which shares
    are cut is found in one pass: in the order of limit / weight, a source is cut if its
    ratio is below what is left over for it and all after it. One narrow row per source
    goes through one task; the number of sources is a property of the collection of
    sources, not of documents. Empty sources have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_rank", F.row_number().over(order) - 1)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights)).cast("int"))
    limited = ranked.withColumn("_weight", weight).withColumn("_limit", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    total = share * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    levelled = limited.withColumn("_level", level)
    # the first source that is not cut sets the level for all after it
    free = F.min(F.when(F.col("_limit") >= F.col("_level") * F.col("_weight"),
                        F.struct(F.col("_limit") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(whole)
    target = F.least(F.col("_limit"), F.coalesce(free["level"] * F.col("_weight"), F.col("_limit")))
    return levelled.select("source", "source_size", target.alias("target"))


def quotas(cells: DataFrame, most: float | None = None) -> DataFrame:
    """``cells`` (source, shard, cell_size, source_size, target) with ``blocks``, a whole number each.

    With ``most`` no cell gets more blocks than it takes to hold ``most`` times its size: its
    further quotients are passed over, and their blocks go to the next cells in line.

    Of a source with b blocks, the cells get those of the b highest quotients
    cell_size / (2k + 1). With c cells the divisor that gives b blocks in all is within a
    share c / b of source_size / b, so a cell's number is within exact * c / b + 1 of its
    exact share: only the quotients in that range are ranked, about seven a cell.
    """
    of_source = Window.partitionBy("source")
    shared = cells.withColumn("_b", F.round(F.col("target") / BLOCK).cast("long")).withColumn(
        "_exact", F.col("cell_size") * F.col("_b") / F.greatest("source_size", F.lit(1)))
    reach = F.ceil(F.col("_exact") * F.count("*").over(of_source) / F.greatest("_b", F.lit(1))) + 1
    ranged = shared.withColumn("_reach", reach)
    cap = F.lit(2**62) if most is None else F.ceil(most * F.col("cell_size") / BLOCK)
    ranged = ranged.withColumn("_cap", cap)
    sure = ranged.withColumn("_sure", F.least(F.greatest(F.floor(F.col("_exact")) - F.col("_reach"), F.lit(0)), F.col("_cap")))
    left = sure.withColumn("_left", F.col("_b") - F.sum("_sure").over(of_source))
    options = left.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_sure"), F.floor(F.col("_exact")) + F.col("_reach")))))
    quotient, free = F.col("cell_size") / (2 * F.col("_k") + 1), F.col("_k") < F.col("_cap")
    order = Window.partitionBy("source").orderBy(free.desc(), quotient.desc(), F.col("shard"), F.col("_k"))
    taken = options.withColumn("_taken", free & (F.row_number().over(order) <= F.col("_left")))
    return taken.groupBy("source", "shard").agg(
        (F.first("_sure") + F.sum(F.col("_taken").cast("long"))).alias("blocks"))


def _order(seed: int) -> Column:
    """Seeded place of a row: MD5 of seed, id and the text's hash, so null and repeated ids spread too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                             F.xxhash64(F.col("text")).cast("string")))


def _mixed(docs: DataFrame, scratch: Scratch, weights, share: float, most: float, seed: int, shard_docs: int) -> DataFrame:
    """(doc_id, source, _order, size, _n, source_size, target, _whole, _extra): rows alike in id, source and text as one.

    Each of the ``_n`` rows is taken ``_whole`` times, and all together ``_extra`` words more.
    Merging them before the shuffle keeps a row that a third of all rows repeat out of one window.
    """
    alike = docs.select("doc_id", "source", n_words().alias("size"), _order(seed).alias("_order")).groupBy(
        "doc_id", "source", "size", "_order").agg(F.count("*").alias("_n"))
    sized = scratch.store(alike, "sizes")
    rows = sized.agg(F.sum("_n")).first()[0] or 0
    shards = max(1, -(-rows // shard_docs))
    number = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    placed = sized.withColumn("shard", number % shards).withColumn("_words", F.col("size") * F.col("_n"))
    cells = placed.groupBy("source", "shard").agg(F.sum("_words").alias("cell_size"))
    goals = scratch.store(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most), "targets")
    with_goal = cells.join(goals, cells["source"].eqNullSafe(goals["source"])).select(
        cells["source"], "shard", "cell_size", "source_size", "target")
    quota = scratch.store(quotas(with_goal, most).select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "blocks")
                          .join(with_goal, F.col("q_source").eqNullSafe(F.col("source")) & (F.col("q_shard") == F.col("shard")))
                          .drop("source", "shard"), "quotas")
    joined = placed.join(quota, placed["source"].eqNullSafe(quota["q_source"]) & (placed["shard"] == quota["q_shard"]))
    ring = Window.partitionBy("source", "shard").orderBy("_order", "size")
    begin = F.sum("_words").over(ring.rowsBetween(Window.unboundedPreceding, -1))
    read = F.least(F.col("blocks") * BLOCK, (most * F.col("cell_size")).cast("long"))  # the last block of a full cell is a part
    joined = joined.withColumn("_begin", F.coalesce(begin, F.lit(0))).withColumn("_read", read)
    whole = F.floor(F.col("_read") / F.greatest("cell_size", F.lit(1)))
    part = F.col("_read") - whole * F.col("cell_size")
    extra = F.least(F.greatest(part - F.col("_begin"), F.lit(0)), F.col("_words"))
    scratch.drop(goals)
    return joined.select("doc_id", "source", "_order", "size", "_n", "source_size", "target", whole.alias("_whole"), extra.alias("_extra"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
        shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of ``docs``.

    ``size`` is the number of words (null text: 0), ``taken`` how many of them the mix
    takes, repeats counted, from the document's start round and round. No document gives more than ``most`` times its size. The
    order in a cell is the MD5 of seed, doc_id and the text's hash, so reruns agree; rows that are alike
    in id, source and text stand side by side. Null sources are one source.
    """
    mixed = _mixed(docs, Scratch(docs.sparkSession), weights, share, most, seed, shard_docs)
    each = mixed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    own = F.least(F.greatest(F.col("_extra") - F.col("_i") * F.col("size"), F.lit(0)), F.col("size"))
    return each.select("doc_id", "size", "source", "source_size", "target", (F.col("_whole") * F.col("size") + own).cast("long").alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
         shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``docs`` as the mix takes them: whole copies, and one cut after its last taken word.

    A document taken twice gives two rows, one not taken none; documents without words
    go. Of rows alike in id, source and text together as many copies come out as the mix takes,
    with the other columns of any one of them. Other columns stay (n_chars, if there, is that of the new text).
    """
    names = [spare(n, docs) for n in ("_key", "_of", "_place", "_size", "_taken", "_alike", "_part", "_row")]
    key, of, place, size, most_, alike, part, row = names
    total = F.col("_n") * F.col("_whole") * F.col("size") + F.col("_extra")
    mixed = _mixed(docs, Scratch(docs.sparkSession), weights, share, most, seed, shard_docs).select(
        F.col("doc_id").alias(key), F.col("source").alias(of), F.col("_order").alias(place), F.col("size").alias(size),
        total.alias(most_), F.col("_n").alias(alike)).filter(F.col(most_) > 0)
    joined = docs.join(mixed, (_order(seed) == mixed[place]) & docs["doc_id"].eqNullSafe(mixed[key]) & docs["source"].eqNullSafe(mixed[of]))
    several = joined.filter(F.col(alike) > 1).groupBy(key, of, place).agg(F.first(F.struct(*joined.columns)).alias(row)).select(f"{row}.*")
    single = joined.filter(F.col(alike) == 1).unionByName(several)
    last = F.floor((F.col(most_) - 1) / F.col(size))
    copies = single.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rest = F.least(F.col(size), F.col(most_) - F.col(part) * F.col(size))
    space = r"\x20\x09-\x0D"
    words = F.split("text", rf"(?<=[^{space}])(?=[{space}])")
    shorter = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), "")
    new = copies.withColumn("text", F.when(rest == F.col(size), F.col("text")).otherwise(shorter))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)
