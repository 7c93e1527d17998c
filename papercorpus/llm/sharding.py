"""Extendible hashing: shards by hash prefix, split further only where they are too large.

A directory of 2^depth entries is indexed by the first ``depth`` bits of a key's hash. A
shard is a prefix whose rows fit the byte limit while those of the prefix one bit shorter
do not, so only oversized prefixes split on another bit. All entries that begin with a
shard's prefix point to it. Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, spare

LIMIT = 8 << 20
#: Bits of the hash, and bits by which the directory grows at once.
BITS, STEP = 60, 8


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a whole number; a null key is hashed as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: int) -> Column:
    """First ``depth`` of the bits as a number."""
    return F.shiftright(bits, BITS - depth)


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(depth, shard, bytes) of every shard of ``rows`` (bits, bytes).

    Starting from the whole, rounds of STEP bits: rows still in oversized prefixes are
    summed by their next STEP bits, every shorter prefix is summed from these, and the
    shortest ones within the limit become shards. Only oversized prefixes reach the next
    round. A prefix of all 60 bits is a shard whatever its size.
    """
    done = None
    left = rows.groupBy("bits").agg(F.sum("bytes").alias("bytes"))
    left = scratch.store(left, "hashes")
    for depth in range(0, BITS, STEP):
        deepest = min(depth + STEP, BITS)
        fine = left.groupBy(prefix(F.col("bits"), deepest).alias("fine")).agg(F.sum("bytes").alias("bytes"))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deepest)))
        summed = fine.select(levels.alias("depth"), "fine", "bytes").select(
            "depth", F.expr(f"shiftright(fine, {deepest} - depth)").alias("shard"), "bytes").groupBy("depth", "shard").agg(
            F.sum("bytes").alias("bytes"))
        summed = scratch.store(summed, "prefixes")
        large = summed.filter(F.col("bytes") > limit)
        parents = large.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        fits = (F.col("bytes") <= limit) | (F.col("depth") == BITS)
        below = summed.filter(fits).withColumn("parent", F.shiftright("shard", 1)).join(parents, ["depth", "parent"], "left_semi")
        top = summed.filter(fits & (F.col("depth") == 0))
        found = scratch.store(below.select("depth", "shard", "bytes").unionByName(top.select("depth", "shard", "bytes")), "shards")
        done = found if done is None else done.unionByName(found)
        if deepest == BITS:
            break
        oversized = large.filter(F.col("depth") == deepest).select(F.col("shard").alias("fine"))
        rest = scratch.store(left.withColumn("fine", prefix(F.col("bits"), deepest)).join(oversized, "fine", "left_semi").drop("fine"), "hashes")
        scratch.drop(left, summed)
        left = rest
        if left.isEmpty():
            break
    return done


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, shard_bytes, text_bytes) of every row of ``docs``.

    ``shard`` is the prefix in binary digits ('' if all fit in one). Sizes are UTF-8 bytes
    of the texts; null and empty texts have none. Every shard is within ``limit``, unless
    one document alone is larger: then it is alone with its hash. Rows that repeat a
    doc_id share its hash while they fit together; where they alone are too large, they
    are dealt on by the hash of doc_id and row number (so even one id that holds a third
    of all rows splits). Null ids count as one id.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = scratch.store(docs.select(F.col("doc_id"), size.alias("text_bytes"), hash_bits(F.col("doc_id")).alias("key_bits"),
                                     F.monotonically_increasing_id().alias("row")), "rows")
    # ids whose own rows pass the limit together
    heavy = rows.groupBy("key_bits").agg(F.sum("text_bytes").alias("sum"), F.count("*").alias("n")).filter(
        (F.col("sum") > limit) & (F.col("n") > 1)).select("key_bits", F.lit(True).alias("heavy"))
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("row").cast("string"))
    keyed = scratch.store(rows.join(heavy, "key_bits", "left").select(
        "doc_id", "text_bytes", F.when(F.col("heavy"), hash_bits(own)).otherwise(F.col("key_bits")).alias("bits")), "rows")
    shards = scratch.store(directory(keyed.select("bits", F.col("text_bytes").alias("bytes")), limit, scratch), "shards")
    scratch.drop(rows)
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # 61 at most
    entry = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("bits"), d).alias("shard")) for d in depths or [0])))
    placed = keyed.select("doc_id", "text_bytes", entry.alias("e")).select("doc_id", "text_bytes", "e.*").join(
        shards, ["depth", "shard"])
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("shard").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return placed.select("doc_id", digits.alias("shard"), F.col("depth").cast("long").alias("depth"),
                         F.col("bytes").alias("shard_bytes"), "text_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, folder: str = "shard") -> None:
    """Write the rows of ``docs`` into one folder per shard, named ``folder``=p and the shard's digits.

    Rows are placed one by one as ``shard`` places them; rows that share an id need not lie in one shard.
    A column that has the folder's name already is an error; all columns are written.
    """
    if folder.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{folder} is a column of the documents: name another folder")
    of, at = spare("_of", docs), spare("_at", docs)
    # of an id whose rows are dealt to several shards, each row goes to the shard of one of them, by turns of its text's hash
    shards = shard(docs, limit).groupBy("doc_id").agg(F.array_sort(F.collect_set("shard")).alias("_shards"))
    named = shards.select(F.col("doc_id").alias(of), F.col("_shards").alias(at))
    turn = F.pmod(F.xxhash64("text"), F.size(at)).cast("int")
    placed = docs.join(named, docs["doc_id"].eqNullSafe(named[of])).withColumn(folder, F.concat(F.lit("p"), F.get(at, turn)))
    placed.drop(of, at).repartition(folder).write.partitionBy(folder).parquet(path)
