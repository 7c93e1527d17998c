"""Homomorphic multiset hash of a text's paragraphs.

Every paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, each place modulo a power of two. The order of paragraphs does
not matter, and adding or taking away a paragraph adds or subtracts its vector. The
vector has two parts:

* 16 places modulo 2^64, filled from two hashes of the paragraph's bytes, 128 bits together: equal
  sums mean equal multisets of paragraphs;
* 256 places modulo 2^32, where each run of three words of the paragraph adds 1 or -1 in
  one place: the cosine of two such sums estimates how much of the runs is shared.

Last comes the number of paragraphs, so that a text of empty lines is not nothing.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ship_package
from .scratch import Scratch
from .words import U64, Texts, as_bytes, mix64, owner, powers, runs

WIDE, PLACES, RUN = 16, 256, 3
_LANES = mix64(np.arange(1, WIDE + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_OTHER = mix64(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB))


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums modulo 2^64 (a column more for the number of paragraphs) and modulo 2^32 of each text."""
    t = Texts(texts)
    begin, end, first = t.lines()
    lines = t.hashes(begin, end)
    up, down = powers(len(t.buf))
    other = np.concatenate([np.zeros(1, U64), np.cumsum(_OTHER[t.buf] * up, dtype=U64)])
    second = mix64((other[end] - other[begin]) * down[begin] + (end - begin).astype(U64))
    text_of_line = owner(first)
    wide = np.zeros((len(texts), WIDE + 1), U64)
    for k in range(WIDE):
        wide[:, k] = np.add.reduceat(mix64(lines ^ _LANES[k]) ^ mix64(second + _LANES[k]), first[:-1])
    wide[:, WIDE] = np.diff(first).astype(U64)

    words = t.words()
    a, b = np.searchsorted(t.starts, begin), np.searchsorted(t.starts, end)
    line = np.repeat(np.arange(len(begin)), b - a)
    last = np.minimum(np.arange(len(words)) + RUN, b[line])  # runs stay in their paragraph
    whole = (last - np.arange(len(words)) == RUN) | (np.arange(len(words)) == a[line])  # a short paragraph is one run
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[: len(words)], dtype=U64)])
    at = np.flatnonzero(whole)
    run = mix64((total[last[at]] - total[at]) * down[at] + (last[at] - at).astype(U64))
    place = text_of_line[line[at]] * PLACES + (run >> U64(32)).astype(np.int64) % PLACES
    sign = np.where(run & U64(1), 1.0, -1.0)
    counts = np.bincount(place, sign, len(texts) * PLACES).astype(np.int64).reshape(len(texts), PLACES)
    return wide, counts.astype(np.uint32)


def encode(wide: np.ndarray, counts: np.ndarray) -> list[str]:
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(wide, counts, strict=True)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    cut = 8 * (WIDE + 1)
    return np.frombuffer(raw[:cut], U64), np.frombuffer(raw[cut:], np.uint32)


def combine(x: str, y: str, remove: bool = False) -> str:
    """Fingerprint of the paragraphs of both; with ``remove`` of x without those of y."""
    (a, b), (c, d) = decode(x), decode(y)
    return encode([a - c if remove else a + c], [b - d if remove else b + d])[0]


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the small parts, 0 at least."""
    if np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1]):
        return 1.0
    a, b = x[1].view(np.int32).astype(float), y[1].view(np.int32).astype(float)
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(min(1.0, max(0.0, a @ b / size))) if size else 0.0


def fingerprint(text: str | Column = "text") -> Column:
    """Fingerprint (hex) of a text; a null text is an empty one, which is one empty paragraph."""
    def hashed(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        return pa.array([x for a, b in runs(rows) for x in encode(*vectors(rows[a:b]))], pa.string())

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(hashed, "string")(column.cast("binary"))


def likeness_of(x: Column, y: Column) -> Column:
    """Likeness of two fingerprints, between 0 and 1."""
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness(decode(u), decode(v)) for u, v in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(alike, "double")(x, y)


def fingerprints(docs: DataFrame, text: str = "text", result: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text in ``result``, all other columns kept."""
    ship_package(docs.sparkSession)
    return docs.withColumn(result, fingerprint(text))


BLOCK, MOST = 512, 4096
_NO_ID = -(2**62)
_OWN, _FIRST, _NEXT = 0, 1, 2


def with_successor(docs: DataFrame, make, schema: str, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``make(ids, texts, next_texts)`` of every row of ``docs`` (doc_id, text), block by block.

    The next of a row is the document of the next larger id, after the last the first; of
    rows that share an id, the smallest text stands for it. Null ids come first. Blocks are ranges
    of ids, as wide as holds about ``block`` of them at the ids' mean density; the first document of a block
    is also sent to the block before it, so texts move once. The rows of an id that has more than
    ``most`` are dealt to groups of their own, each with the next document's text.
    Ids, blocks and ids with many rows are stored narrow tables of measured size, which Spark broadcasts
    below its threshold only; beyond that the texts move twice. No task holds all ids or blocks.
    """
    scratch = Scratch(docs.sparkSession)
    number = F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("long")
    ids = scratch.store(docs.select(number.alias("id")).groupBy("id").agg(F.count("*").alias("rows")), "ids")
    low, high, count = ids.filter(F.col("id") != _NO_ID).agg(F.min("id"), F.max("id"), F.count("*")).first()
    width = min(2**62, max(1, -(-(high - low + 1) * block // count))) if count else 1
    at = F.when(F.col("id") == _NO_ID, F.lit(_NO_ID)).otherwise(F.expr(f"id div {width}L"))
    placed = ids.withColumn("block", at)
    blocks = placed.groupBy("block").agg(F.min("id").alias("least"))
    ranges = scratch.store(blocks.repartitionByRange("block").withColumn("range", F.spark_partition_id()), "blocks")
    prior = F.lag("block").over(Window.partitionBy("range").orderBy("block"))
    ends = ranges.groupBy("range").agg(F.max("block").alias("last"))  # a row per task, as is what the next window orders
    across = ends.select("range", F.lag("last").over(Window.orderBy("range")).alias("before"))
    final = ends.agg(F.max("last").alias("final"))
    before = scratch.store(ranges.withColumn("prior", prior).join(across, "range").crossJoin(final).select(  # one row
        F.col("block").alias("own"), "least", F.coalesce("prior", "before", "final").alias("prior")), "blocks")

    following = F.lead("id").over(Window.partitionBy("block").orderBy("id"))
    many = placed.withColumn("following", following).filter(F.col("rows") > most)
    many = many.join(before.select(F.col("prior").alias("block"), F.col("least").alias("after")), "block")
    hot = scratch.store(many.select(F.col("id").alias("hot"), F.ceil(F.col("rows") / most).alias("parts"),
                                    F.coalesce("following", "after").alias("next")), "many-rows")

    keyed = docs.select("doc_id", number.alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("block", at)
    turn = F.when(F.col("hot").isNotNull(), 1 + F.pmod(F.xxhash64("text", F.spark_partition_id()), F.col("parts"))).otherwise(F.lit(0))
    columns = ["block", "hot", "part", "kind", "doc_id", "id", "text"]

    def row(kind: int, part: Column, df: DataFrame) -> DataFrame:
        return df.withColumns({"kind": F.lit(kind), "part": part.cast("long")}).select(*columns)

    own = row(_OWN, turn, keyed.join(hot, keyed["id"] == hot["hot"], "left"))
    heads = keyed.join(before, (F.col("block") == F.col("own")) & (F.col("id") == F.col("least"))).groupBy("prior").agg(
        F.min("text").alias("text"), F.first("id").alias("id"))
    heads = row(_NEXT, F.lit(0), heads.select(F.col("prior").alias("block"), "id", "text", F.lit(None).cast("bigint").alias("doc_id"),
                                              F.lit(None).cast("bigint").alias("hot")))
    firsts = keyed.join(hot, keyed["id"] == hot["hot"]).groupBy("block", "id").agg(F.min("text").alias("text"))
    firsts = row(_FIRST, F.lit(0), firsts.withColumns({"doc_id": F.lit(None).cast("bigint"), "hot": F.lit(None).cast("bigint")}))
    nexts = keyed.join(hot, keyed["id"] == hot["next"]).groupBy("hot", "parts").agg(F.min("text").alias("text"))
    nexts = nexts.withColumn("id", F.col("hot")).withColumns({"block": at, "doc_id": F.lit(None).cast("bigint")})
    nexts = nexts.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    nexts = row(_NEXT, F.col("each"), nexts)

    def made(table: pa.Table) -> pa.Table:
        kind, ids, texts = (table.column(c).to_pylist() for c in ("kind", "id", "text"))
        tail = next((t for t, k in zip(texts, kind, strict=True) if k == _NEXT), None)
        first: dict[int, bytes] = {}
        for i, t, k in zip(ids, texts, kind, strict=True):
            if k != _NEXT and (i not in first or t < first[i]):
                first[i] = t
        order = sorted(first)
        after = dict(zip(order, [*(first[i] for i in order[1:]), tail], strict=False))
        own = [n for n, k in enumerate(kind) if k == _OWN]
        doc_ids = table.column("doc_id").to_pylist()
        return make([doc_ids[n] for n in own], [texts[n] for n in own], [after[ids[n]] for n in own])

    whole = own.unionByName(heads).unionByName(firsts).unionByName(nexts)
    return whole.groupBy("block", "hot", "part").applyInArrow(made, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_edited(ids: list, texts: list[bytes], following: list[bytes]) -> pa.Table:
    """Fingerprints of texts and of their edited texts, and their likeness to these and to the next texts."""
    whole = [t.decode() for t in texts]
    changed = [edited(t, n.decode()).encode() for t, n in zip(whole, following, strict=True)]
    known = list(dict.fromkeys([*texts, *changed, *following]))
    parts = {}
    for a, b in runs(known):
        parts |= zip(known[a:b], zip(*vectors(known[a:b]), strict=True), strict=True)
    written = {t: encode([v[0]], [v[1]])[0] for t, v in parts.items()}
    near = [[likeness(parts[t], parts[o]) for t, o in zip(texts, others, strict=True)] for others in (changed, following)]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in whole], pa.int64()),
        "edited_sha256": pa.array([sha256(t).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([written[t] for t in texts], pa.string()),
        "edited_fingerprint": pa.array([written[t] for t in changed], pa.string()), "near_edited": pa.array(near[0], pa.float64()),
        "near_next": pa.array(near[1], pa.float64())})


def edited_fingerprints(docs: DataFrame, **blocks: int) -> DataFrame:
    """EDITED of every row of ``docs`` (doc_id, text); the next document as in ``with_successor``. A null text is empty."""
    ship_package(docs.sparkSession)
    return with_successor(docs, compare_edited, EDITED, **blocks)
