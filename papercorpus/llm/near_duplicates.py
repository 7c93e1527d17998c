"""Near duplicates by circulant MinHash, banding and exact Jaccard checks.

Two permutations of the 2^32 shingle numbers make all signature coordinates: the first
scatters a document's shingles once, the second is read at positions shifted round the
circle by the number of the coordinate. Six coordinates make a band, 32 bands in all: a
pair at 0.85 shares no band with a chance of about 3e-7, at 0.8 of 6e-5. For sets that are
still to be told apart (step 3) one bit of each of 1,024 coordinates is made: a pair at s
differs in about 512 * (1 - s) of them, and pairs are passed over only beyond six standard
deviations of that (a chance of 1e-9).

Links are found without writing out all pairs of a bucket:

1. Documents with equal shingle sets form classes; one document stands for each.
2. In each bucket of a band, every class is checked against one hub, on full sets: the
   class of most copies. Buckets whose classes are now all in one component are done; in
   the others all are checked against a second hub, the class most of whose shingles are
   found in 16 classes of the bucket.
3. In the buckets still open the shingles of each class are put in order, those rare among 16 classes of the bucket's
   hub first (any order common to the hub's classes is exact; this one is short). Of two
   sets as alike as asked, the first n - ceil(2 * limit / (1 + limit) * n) + 1 of the
   smaller and the first n - ceil(limit * n) + 1 of the larger one share a shingle, so
   classes of different components meet on these, not on what all of them share. A pair
   meets once, not at every shingle that it shares: each row also has the shingles just before
   its own in the order, and rows that have one of these in common leave the pair to an
   earlier meeting. Pairs that sizes and bits do not rule out are checked on full sets.

So a bucket of thousands of copies costs a row per copy, and no link that would join two
components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, spare
from .words import U64, Texts, as_bytes, mix64, runs, windows

ROWS, BANDS = 6, 32
SHINGLE, PERCENT = 5, 80
U32 = np.uint32
FINE = 1024
#: Shingles before a row's own that it carries: alike sets nearly always share one of so many.
BEFORE = 4
BITS = [f"bits_{k}" for k in range(FINE // 64)]


def permuted(x: np.ndarray, salt: int) -> np.ndarray:
    """A fixed permutation of the numbers below 2^32."""
    x = x ^ U32(salt)
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signatures(places: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` coordinates of each set; ``places``: sets end to end, none empty."""
    out = np.empty((len(first), count), U32)
    scattered = permuted(places, 0x5BD1E995)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(permuted(scattered + U32(k), 0), first)
    return out


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters A-Z in lower case."""
    t = Texts([x.lower() for x in texts])
    words = t.words()
    grams = windows(words, shingle)
    sets = []
    for a, b in zip(t.first[:-1], t.first[1:], strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            sets.append(windows(words[a:b], b - a) ^ U64(b - a))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _described(shingle: int):
    def described(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        sizes, ones, twos, bands = [], [], [], []
        salts = mix64(np.arange(1, BANDS + 1, dtype=U64))
        for a, b in runs(rows):
            sets = shingle_sets(rows[a:b], shingle)
            filled = [s for s in sets if len(s)]
            keys = iter(())
            if filled:
                flat = np.concatenate(filled)
                first = np.concatenate([[0], np.cumsum([len(s) for s in filled])[:-1]])
                signature = signatures((flat >> U64(32)).astype(U32), first, ROWS * BANDS)
                rolled = np.zeros((len(filled), BANDS), U64) + salts
                for k in range(ROWS):
                    rolled = mix64(rolled + signature[:, k::ROWS].astype(U64))
                keys = iter(rolled.view(np.int64))
                one = iter(np.add.reduceat(flat, first).view(np.int64))
                two = iter(np.add.reduceat(mix64(flat), first).view(np.int64))
            for s in sets:
                sizes.append(len(s))
                ones.append(int(next(one)) if len(s) else 0)
                twos.append(int(next(two)) if len(s) else 0)
                bands.append(next(keys) if len(s) else None)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["size", "one", "two", "bands"])

    return F.arrow_udf(described, "struct<size:bigint,one:bigint,two:bigint,bands:array<bigint>>").asNondeterministic()


def _sets(shingle: int):
    def sets(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        return pa.array([s.tobytes() for a, b in runs(rows) for s in shingle_sets(rows[a:b], shingle)], pa.binary())

    return F.arrow_udf(sets, "binary").asNondeterministic()


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.concatenate([u, v])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _common(sets: pa.Array) -> pa.Array:
    """Shingles found in two or more of the sets, in order, then in how many."""
    out = []
    for group in sets:
        found, seen = np.unique(np.concatenate([np.frombuffer(x.as_py(), U64) for x in group]), return_counts=True)
        out.append(np.concatenate([found[seen > 1], seen[seen > 1].astype(U64)]).tobytes())
    return pa.array(out, pa.binary())


def _times(x: pa.Scalar, y: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set, and in how many of the sampled sets each was found (0 for one or none)."""
    u, v = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
    v, seen = v[: len(v) // 2], v[len(v) // 2 :]
    times = np.zeros(len(u), U64)
    if len(v):
        at = np.minimum(np.searchsorted(v, u), len(v) - 1)
        times[v[at] == u] = seen[at[v[at] == u]]
    return u, times


def _centrality(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [float(_times(x, y)[1].mean()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "size", "hub")), pa.array(scores, pa.float64())],
                                         names=["node", "size", "hub", "score"])


def _fine_bits(sets: list[np.ndarray], together: int = 256) -> np.ndarray:
    """One bit of each of FINE coordinates of each set, packed; runs of sets share the numpy calls."""
    bits = np.zeros((len(sets), FINE // 8), np.uint8)
    for a in range(0, len(sets), together):
        some = sets[a : a + together]
        first = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]]).astype(np.int64)
        low = signatures((np.concatenate(some) >> U64(32)).astype(U32), first, FINE) & U32(1)
        bits[a : a + together] = np.packbits(low.astype(np.uint8), axis=1)
    return bits


def _rarest(percent: int):
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, early, before = [], [np.zeros(0, np.int32)], [np.zeros(0, bool)], []
            whole: list[np.ndarray] = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, times = _times(x, y)
                order = np.argsort(times, kind="stable")  # u is in order, so ties are
                prefix = (u[order][: len(u) + 1 + -percent * len(u) // 100] >> U64(32)).astype(U32).view(np.int32)
                found.append(prefix)
                sizes.append(len(prefix))
                early.append(np.arange(sizes[-1]) <= len(u) + -2 * percent * len(u) // (100 + percent))
                values = prefix.tolist()
                before += [values[max(0, i - BEFORE) : i] for i in range(len(values))]
                whole.append(u)
            bits = _fine_bits(whole)
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("node", "hub", "size", "component")),
                 pa.array(np.concatenate(found)), pa.array(np.concatenate(early)), pa.array(before, pa.list_(pa.int32())),
                 *(pa.array(np.ascontiguousarray(b)).take(take) for b in bits.view(np.int64).T)],
                names=["node", "hub", "size", "component", "shingle", "early", "before", *BITS])

    return rarest


def _checked(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets are as alike as ``percent``."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        _linked(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text, ...).

    Documents are linked if 100 * shared >= ``percent`` * all distinct shingles of
    ``shingle`` words, A-Z in lower case. A text of fewer words is one shingle; null and
    empty texts have none and are linked with nothing. ``component_id`` is the smallest
    doc_id reachable, ``kept`` marks the rows that carry it. Rows that repeat a doc_id are
    one document if their texts have equal sets; otherwise they are linked through their
    id. Rows with a null doc_id are compared with nothing, and kept with a null component.
    Whole texts are used.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         _described(shingle)(F.col("text").cast("binary")).alias("d"))
    found = scratch.store(narrow.select("doc_id", "d.*"), "signatures")
    filled = found.filter("size > 0 and doc_id is not null")

    kinds = filled.groupBy("size", "one", "two").agg(
        F.min("doc_id").alias("node"), (-F.count("*")).alias("rank"))
    classes = scratch.store(filled.select("size", "one", "two", "doc_id", "bands").join(
        kinds.withColumnRenamed("node", "doc_id"), ["size", "one", "two", "doc_id"]), "classes")
    members = classes.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "size", "rank", F.explode("bands").alias("band"))
    first_hub = F.min(F.struct("rank", "node", "size")).alias("first")
    hubs = members.groupBy("band").agg(first_hub, F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select(
        "band", F.col("first.node").alias("hub"), F.col("first.size").alias("hub_size"))
    shared = scratch.store(members.drop("rank").join(hubs, "band"), "buckets")

    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.store(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("node"), _sets(shingle)(F.col("text").cast("binary")).alias("shingles")), "sets")

    def set_as(node: str, shingles: str) -> DataFrame:
        return sets.select(F.col("node").alias(node), F.col("shingles").alias(shingles))

    def alike(a: str, b: str):
        return (100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b)))

    def to_check(spokes: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of each node and its center (node, size, center, center_size)."""
        return spokes.filter("node <> center").filter(alike("size", "center_size")).select(
            F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()

    first = to_check(shared.select("node", "size", F.col("hub").alias("center"), F.col("hub_size").alias("center_size")))
    links = scratch.store(_checked(first, sets, percent), "links")
    # copies in a class, and rows that share an id, are linked without a check
    same = filled.join(kinds, ["size", "one", "two"]).select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")

    def still_open(found: DataFrame, label: str) -> DataFrame:
        """Nodes by hub in the buckets that hold two components or more."""
        labels = scratch.store(components(found, scratch), "components")
        placed = shared.join(labels, "node", "left").select(
            "band", "hub", "node", "size", F.coalesce("component", "node").alias("component"))
        bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
            "low < high").select("band")
        nodes = scratch.store(placed.join(bands, "band", "left_semi").drop("band").distinct(), label)
        scratch.drop(labels)
        return nodes

    nodes = still_open(links, "open-1")
    some = nodes.groupBy("hub", F.pmod(F.xxhash64("node"), F.lit(16))).agg(F.min("node").alias("node")).select("hub", "node")
    common = F.arrow_udf(_common, "binary").asNondeterministic()
    orders = scratch.store(some.join(set_as("node", "x"), "node").groupBy("hub").agg(
        F.collect_list("x").alias("sets")).select("hub", common("sets").alias("y")), "orders")

    def ordered(of: DataFrame) -> DataFrame:
        return of.join(set_as("node", "x"), "node").join(orders, "hub").select("node", "hub", "size", "component", "x", "y")

    central = scratch.store(ordered(nodes).mapInArrow(_centrality, "node bigint, size bigint, hub bigint, score double"), "centrality")
    centers = central.groupBy("hub").agg(F.max(F.struct("score", "node", "size")).alias("best")).select(
        "hub", F.col("best.node").alias("center"), F.col("best.size").alias("center_size"))
    second = to_check(nodes.join(centers, "hub").select("node", "size", "center", "center_size")).join(first, ["a", "b"], "left_anti")
    links_2 = scratch.store(_checked(second, sets, percent), "links")
    scratch.drop(nodes, central)
    nodes = still_open(links.unionByName(links_2), "open-2")
    rest = scratch.store(ordered(nodes).mapInArrow(
        _rarest(percent), "node bigint, hub bigint, size bigint, component bigint, shingle int, early boolean, before array<int>"
        + "".join(f", {b} bigint" for b in BITS)), "open-prefixes")

    def side(name: str, of: DataFrame) -> DataFrame:
        return of.select(*(F.col(c).alias(f"{c}_{name}") for c in ("hub", "shingle", "size", "component", "before", *BITS)),
                           F.col("node").alias(name))

    differing = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS), F.lit(0))
    apart = FINE * (1 - percent / 100) / 2
    near = differing <= apart + 6 * (apart * (1 - apart / FINE)) ** 0.5
    smaller = (F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))
    open_pairs = side("a", rest.filter("early")).join(
        side("b", rest), (F.col("hub_a") == F.col("hub_b")) & (F.col("shingle_a") == F.col("shingle_b")) & smaller
        & (F.col("component_a") != F.col("component_b")) & alike("size_a", "size_b") & near
        & ~F.arrays_overlap("before_a", "before_b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = scratch.store(_checked(open_pairs, sets, percent), "links")
    scratch.drop(nodes, orders, rest, shared, sets)

    all_links = links.unionByName(links_2).unionByName(more).unionByName(same)
    final = scratch.store(components(all_links, scratch), "components")
    scratch.drop(links, links_2, more, classes)
    placed = found.select("doc_id", F.col("size").alias("n_shingles")).join(
        final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of documents that near_duplicates does not keep."""
    away = near_duplicates(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias(spare("_away", docs))).distinct()
    return docs.join(away, docs["doc_id"] == away[away.columns[0]], "left_anti")
