"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is read as words (A-Z in lower case), each followed by a space, and one end sign.
The bits of every byte are predicted by six predictors whose contexts are the place in
the word and the last one to five bytes of it, hashed into tables of counts. Their
log-odds are added up with weights from a set that is gated by the longest context seen
before and how often. The weights are learnt online, by gradient steps over a stream of
bits in small batches; each bit is predicted without its own occurrence, as it would be
in a new text. A last table refines the mixed probability by gate and level, adapting to
the bits as they come. Counts, gradients and refinement weigh a bit by the occurrences
of its word in the training texts. At last a word's probability is shared between this
model and the word's own frequency, in one proportion for all words, chosen on the same
terms over all words of the training texts.

A bit depends on the word up to it alone, so a prefix that many words of a batch begin
with is read once with all their occurrences, every distinct word is scored once, and
texts add up the scores of their words. The work is laid out so:

* documents are dealt into blocks of bounded size; each block hands on its distinct words
  with counts, so a frequent word costs one row per block, not per occurrence;
* words are counted over all blocks, and their contexts into tables that are broadcast, so of a
  size that is an argument (2^slot_bits places for each predictor, 8 bytes each; the exact word
  counts grow with the corpus, whatever the tables hold);
* each lane of words learns its own weights, which are averaged;
* each block gets the scores of its own words back and adds them up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import BYTE, U64, mix64, powers

U32 = np.uint32
ORDERS = 6
SLOT_BITS = 20
PIECE = 1 << 14
GATES, LEVELS = ORDERS * 4, 33
BLOCK_BYTES, LEAST_BLOCKS, LANE_WORDS = 8 << 20, 64, 250_000
STEP, RATE, PRIOR = 2048, 0.05, 0.1
SHARES = tuple(1 - 2.0**-(k / 4) for k in range(1, 40))
END = b"\n"
BATCH = 1 << 17


class Bits(NamedTuple):
    """The bits of the distinct prefixes of a run of words, eight for each prefix's last byte.

    ``slots`` (ORDERS x bits), ``ones`` (values) and ``weight`` (occurrences) are those of bits;
    ``prefix`` and ``word`` are those of each byte of the words.
    """

    slots: np.ndarray
    ones: np.ndarray
    weight: np.ndarray
    prefix: np.ndarray
    word: np.ndarray

    def by_word(self, log_p: np.ndarray, words: int) -> np.ndarray:
        """Sum over each word of what its bits hold."""
        return np.bincount(self.word, log_p.reshape(-1, 8).sum(1)[self.prefix], words)


def bits_of(words: list[bytes], counts: np.ndarray | None = None, slot_bits: int = SLOT_BITS) -> Bits:
    """Words end to end, each closed by a space unless it is the end sign."""
    closed = [w if w == END else w + b" " for w in words]
    buf = np.frombuffer(b"".join(closed), np.uint8)
    sizes = np.fromiter(map(len, closed), np.int64, len(closed))
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(buf))
    up, down = powers(len(buf) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[buf] * up[: len(buf)], dtype=U64)])
    whole = mix64((total[1:] - total[start]) * down[start] + (at - start + 1).astype(U64))
    _, at, prefix = np.unique(whole, return_index=True, return_inverse=True)
    weight = np.bincount(prefix, None if counts is None else counts[word], len(at))
    start, value = start[at], buf[at].astype(U32)
    node = np.empty((len(at), 8), U32)
    for bit in range(8):
        node[:, bit] = (U32(1) << U32(bit)) | (value >> U32(8 - bit))
    node *= U32(0x9E3779B1)
    slots = np.empty((ORDERS, len(at) * 8), U32)
    for k in range(ORDERS):
        if k == 0:
            context = mix64(np.minimum(at - start, 15).astype(U64) + U64(77))
        else:
            a = np.maximum(at - k, start)
            context = mix64((total[at] - total[a]) * down[a] + ((at - a) * 8 + k).astype(U64))
        hashed = ((context >> U64(32)).astype(U32)[:, None] ^ node) * U32(0x85EBCA6B)
        hashed ^= hashed >> U32(15)
        slots[k] = (hashed * U32(0xC2B2AE35) >> U32(32 - slot_bits)).ravel()
    return Bits(slots, np.unpackbits(buf[at]), np.repeat(weight, 8), prefix, word)


def batches_of(table: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and their counts, about BATCH bytes at a time."""
    for batch in table:
        words, counts = batch.column("word").to_pylist(), batch.column("count").to_numpy(zero_copy_only=False)
        sizes = np.cumsum([len(w) + 1 for w in words]) // BATCH
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(words)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield words[a:b], counts[a:b]


def count_contexts(slot_bits: int):
    """Counts of zeros and ones in each slot, in compressed pieces of the tables."""
    def counted(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = np.zeros((ORDERS, 2 << slot_bits)), 2 * PIECE
        for words, counts in batches_of(table):
            bits = bits_of(words, counts, slot_bits)
            for k in range(ORDERS):
                held[k] += np.bincount(bits.slots[k].astype(np.int64) * 2 + bits.ones, bits.weight, 2 << slot_bits)
        rows = [(k, p, held[k, p * places : (p + 1) * places]) for k in range(ORDERS) for p in range(-(-held.shape[1] // places))]
        rows = [(k, p, zlib.compress(x.tobytes(), 1)) for k, p, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.binary())], names=["k", "piece", "counts"])

    return counted


def add_pieces(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), float) for x in table.column("counts").to_pylist())
    return pa.table({"k": table.column("k")[:1], "piece": table.column("piece")[:1],
                     "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def inputs(bits: Bits, tables: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each predictor (bits x ORDERS) and the gate of each bit.

    ``tables``: for each predictor zeros and ones of each slot, side by side. ``own``: how
    often a bit itself is in the counts where it should not be.
    """
    x = np.empty((len(bits.ones), ORDERS), np.float32)
    gate = np.zeros(len(bits.ones), np.int64)
    for k in range(ORDERS):
        zeros, ones = tables[k].reshape(-1, 2)[bits.slots[k]].T
        if own is not None:
            ones = np.maximum(ones - own * bits.ones, 0)
            zeros = np.maximum(zeros - own * (1 - bits.ones), 0)
        seen = zeros + ones
        x[:, k] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
        level = (seen >= 2).view(np.int8) + (seen >= 8).view(np.int8) + (seen >= 64).view(np.int8)
        np.copyto(gate, level + np.int8(4 * k), where=seen > 0)
    return x, gate


class Mixer:
    """Weights by gate, and the refinement table by gate and level of the mixed log-odds."""

    def __init__(self, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.full((GATES, ORDERS), 1 / 3) if weights is None else weights
        self.moved = np.full((GATES, ORDERS), 1e-4)
        level = 1 / (1 + np.exp(-(np.arange(LEVELS) - 16) / 2))
        prior = np.stack([1 - level, level], 1) * 20
        self.refined = np.broadcast_to(prior, (GATES, LEVELS, 2)).copy() if refined is None else refined

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -16, 16)
        return odds, 1 / (1 + np.exp(-odds))

    def probability(self, odds: np.ndarray, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        place = np.clip(odds * 2 + 16, 0, LEVELS - 1.001)
        low = place.astype(np.int64)
        share = self.refined[..., 1] / self.refined.sum(-1)
        near = share[gate, low] * (low + 1 - place) + share[gate, low + 1] * (place - low)
        return np.clip((p + near) / 2, 1e-7, 1 - 1e-7)

    def learn(self, x: np.ndarray, gate: np.ndarray, odds: np.ndarray, p: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> None:
        """A step over a batch of bits, each as many times as ``weight`` says."""
        total = np.bincount(gate, weight, GATES)
        off = weight * (ones - p)
        for k in range(ORDERS):
            step = np.bincount(gate, off * x[:, k], GATES)
            step /= np.maximum(total, 1)
            self.moved[:, k] += step**2
            self.weights[:, k] += RATE * step / np.sqrt(self.moved[:, k])
        level = np.clip(np.rint(odds * 2 + 16), 0, LEVELS - 1).astype(np.int64)
        flat = (gate * LEVELS + level) * 2 + ones
        self.refined += np.bincount(flat, weight, GATES * LEVELS * 2).reshape(GATES, LEVELS, 2)


def learn(broadcast, slot_bits: int):
    """Online pass: the log-probability of each word as met, and at the end the mixer."""
    def learned(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "count", "log_p", "part", "place", "value"]
        mixer, tables = Mixer(), broadcast.value
        kinds = [pa.binary(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.float64()]

        def rows(*columns) -> pa.RecordBatch:
            n = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k)
                                               for c, k in zip(columns, kinds, strict=True)], names=names)

        met = False
        for words, counts in batches_of(table):
            met = True
            bits = bits_of(words, counts, slot_bits)
            x, gate = inputs(bits, tables, np.ones(len(bits.ones), np.float32))
            log_p = np.zeros(len(bits.ones))
            for a in range(0, len(log_p), STEP):
                s = slice(a, a + STEP)
                odds, p = mixer.mixed(x[s], gate[s])
                q = mixer.probability(odds, p, gate[s])
                log_p[s] = np.log(np.where(bits.ones[s] == 1, q, 1 - q))
                mixer.learn(x[s], gate[s], odds, p, bits.ones[s], bits.weight[s])
            yield rows(words, counts, bits.by_word(log_p, len(words)), None, None, None)
        if met:
            for part, values in (("weights", mixer.weights.ravel()), ("refined", mixer.refined.ravel())):
                yield rows(None, None, None, [part] * len(values), np.arange(len(values)), values)

    return learned


def score(broadcast, total: int, share: float, slot_bits: int):
    """(word, count, score): log10 probability of each word."""
    def scored(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights, refined = broadcast.value
        mixer = Mixer(weights, refined)
        for words, counts in batches_of(table):
            bits = bits_of(words, slot_bits=slot_bits)
            x, gate = inputs(bits, tables, None)
            odds, p = mixer.mixed(x, gate)
            q = mixer.probability(odds, p, gate)
            log_p = bits.by_word(np.log(np.where(bits.ones == 1, q, 1 - q)), len(words))
            with np.errstate(divide="ignore"):
                own = np.log(counts * (share / max(total, 1)))
            both = np.logaddexp(own, log_p + np.log(1 - share)) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(both)],
                                             names=["word", "count", "score"])

    return scored


def block_words(table: pa.Table) -> pa.Table:
    """Distinct words of a block's texts and how often each is in the training texts."""
    counts: Counter = Counter()
    for text, held in zip(table.column("text").to_pylist(), table.column("held_out").to_pylist(), strict=True):
        words = text.lower().split()
        words.append(END)
        if held:
            for w in set(words):
                counts.setdefault(w, 0)
        else:
            counts.update(words)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(counts), pa.int64()),
                     "word": pa.array(list(counts), pa.binary()), "count": pa.array(list(counts.values()), pa.int64())})


def block_scores(total: int, distinct: int):
    def scored(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        counts = words.column("count").to_numpy()
        base = np.log10((counts + 1) / (total + distinct + 1))
        model = words.column("score").to_numpy()
        out = []
        for text in docs.column("text").to_pylist():
            at = np.array([place[w] for w in text.lower().split()] + [place[END]])
            out.append((len(at), int((counts[at] > 0).sum()), base[at].sum(), model[at].sum(), len(text)))
        n, known, base_score, score_, size = zip(*out, strict=True) if out else ((),) * 5
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([total] * len(n), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score_, pa.float64()),
            "bits_per_byte": pa.array([-s / np.log10(2) / (b + 1) for s, b in zip(score_, size, strict=True)], pa.float64())})

    return scored


SCHEMA = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double, bits_per_byte double")


def score_texts(docs: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """SCHEMA of every row of ``docs`` (doc_id, text, ...), learnt from those not held out.

    ``held_out``: crc32 of the id as text modulo 7 is 2 (a null id counts as ''). Null
    texts are empty ones, which hold the end sign alone. ``base_score`` is that of the
    words' counts with one added; ``score`` the model's log10 probability of words and
    end; ``bits_per_byte`` the same in bits over the bytes of text and end. Rows that
    repeat a document are scored, and learnt from, each for itself. Words of any length
    are taken whole. ``slot_bits``: each predictor counts in 2^slot_bits places, which contexts
    that hash alike share; the tables are broadcast, 48 * 2^slot_bits bytes. With no training text all counts are 0 and the untrained mixer is used.
    """
    scratch = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(LEAST_BLOCKS, -(-(size[0] or 0) // BLOCK_BYTES))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                        (F.crc32(key.cast("binary")) % 7 == 2).alias("held_out"),
                        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    found = scratch.store(keyed.groupBy("block").applyInArrow(block_words, "block bigint, word binary, count bigint"), "block-words")
    words = scratch.store(found.groupBy("word").agg(F.sum("count").alias("count")), "words")
    total, distinct, all_words = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0), F.count("*")).first()

    lanes = max(8, -(-all_words // LANE_WORDS))
    stream = words.filter("count > 0").repartition(lanes, "word").sortWithinPartitions("word")
    pieces = stream.mapInArrow(count_contexts(slot_bits), "k int, piece int, counts binary").groupBy("k", "piece").applyInArrow(
        add_pieces, "k int, piece int, counts binary")
    tables = np.zeros((ORDERS, 2 << slot_bits), np.float32)
    for row in pieces.toLocalIterator():  # of the size that slot_bits sets, whatever the corpus
        part = np.frombuffer(row["counts"], np.float32)
        tables[row["k"], row["piece"] * 2 * PIECE :][: len(part)] = part
    shared = spark.sparkContext.broadcast(tables)
    online = scratch.store(stream.mapInArrow(
        learn(shared, slot_bits), "word binary, count bigint, log_p double, part string, place int, value double"), "online")
    mixer = Mixer()
    weights, refined = mixer.weights.ravel(), mixer.refined.ravel()
    lanes_met = F.count("*").alias("lanes")
    for row in online.filter("part is not null").groupBy("part", "place").agg(F.sum("value").alias("value"), lanes_met).collect():
        if row["part"] == "weights":
            weights[row["place"]] = row["value"] / row["lanes"]
        else:  # every lane began with the same prior
            refined[row["place"]] = row["value"] - (row["lanes"] - 1) * refined[row["place"]]
    fits = [F.sum(F.col("count") * F.log(F.lit(s) * (F.col("count") - 1) / max(total - 1, 1) + (1 - s) * F.exp("log_p"))).alias(f"s{k}")
            for k, s in enumerate(SHARES)]
    chosen = online.filter("part is null").agg(*fits).first()
    share = max(zip(chosen, SHARES, strict=True), key=lambda x: (x[0] is not None, x[0] or 0.0))[1]
    shared.destroy()
    final = spark.sparkContext.broadcast((tables, weights.reshape(GATES, ORDERS), refined.reshape(GATES, LEVELS, 2)))
    scores = scratch.store(words.repartition(lanes, "word").sortWithinPartitions("word").mapInArrow(
        score(final, total, share, slot_bits), "word binary, count bigint, score double"), "word-scores")
    final.destroy()
    scratch.drop(words, online)
    known = found.select("block", "word").join(scores, "word")
    return keyed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(block_scores(total, distinct), SCHEMA)
