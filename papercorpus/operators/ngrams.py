"""Counts of all word n-grams of a table of texts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship_package, spread

SCHEMA = "n int, gram string, seen long"
PACKED = "part int, n int, grams long, bytes long, packed binary"
TASK_BYTES = 1 << 22  # text whose n-grams one task adds up, about a million rows
CHUNK_BYTES = 1 << 23  # words counted at once before the shuffle
BATCH_ROWS = 1 << 16
TASK_PLACES, MOST_PLACES = 100, 1_000_000  # places in the texts that tell how n-grams spread, per task and in all
WINDOW = 100  # bytes read at such a place
KEYS = 1 << 63
ZSTD_LEVEL = 3
SPACE = pa.scalar(" ", pa.large_string())

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def count_ngrams(texts: DataFrame, column: str, longest: int = 4) -> DataFrame:
    """(n, gram, seen) over all texts, n from 1 to ``longest`` (at least 2), in lower case.

    ``texts`` as read: their bytes are summed first, so that the number of tasks follows them.
    Counts are made per chunk of words before the shuffle, so a hot n-gram is one row a chunk. N-grams of
    the two greatest lengths meet by their first ``longest`` - 1 words: only those of ``longest`` words are
    shuffled, and the shorter ones are added up from them. Each task adds up a range of the n-grams in
    order, so that neighbours share most of their words and are shuffled as compressed runs.
    """
    if longest < 2:
        raise ValueError("the longest n-gram must have at least two words")
    ship_package(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    bounds = _bounds(texts, column, longest - 1, size, tasks)
    lowered = spread(texts).select(F.lower(F.coalesce(column, F.lit(""))).alias("text"))
    parts = lowered.mapInArrow(_then(_counted(longest), _packed(bounds)), PACKED)
    return parts.repartitionById(tasks, "part").mapInArrow(_then(_unpacked, _added(longest)), SCHEMA)


def _bounds(texts: DataFrame, column: str, words: int, size: int, tasks: int) -> list[str]:
    """N-grams of up to ``words`` words that cut all n-grams into ``tasks`` ranges of about the same size.

    They are read at some places of the texts and only tell which task gets a row. As none is longer than
    ``words``, n-grams that begin with the same ``words`` words are never parted.
    """
    step = max(1, size // min(TASK_PLACES * tasks, MOST_PLACES))
    rows = texts.select(F.coalesce(column, F.lit(""))).mapInArrow(_placed(step, words), "gram string").collect()
    found = sorted(row.gram for row in rows)
    return sorted({found[k * len(found) // tasks] for k in range(1, tasks)}) if found else []


def _placed(step: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Up to ``words`` words that follow a place, at a place in each ``step`` bytes."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Random(TaskContext.get().partitionId()).randrange(step)
        for batch in batches:
            data, bound = _strings(batch.column(0))
            found = []
            while place < len(data):
                text = np.searchsorted(bound, place, "right")
                window = data[place : min(place + WINDOW, bound[text])].tobytes().lower()
                if place > bound[text - 1] and ALNUM[data[place - 1]]:
                    window = re.sub(rb"^[a-z0-9]+", b"", window)
                found.append(b" ".join(re.findall(rb"[a-z0-9]+", window)[:words]).decode())
                place += step
            place -= len(data)
            yield pa.record_batch({"gram": pa.array([gram for gram in found if gram], pa.string())})

    return placed


def _then(first: Callable, second: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: second(first(batches))


def _text(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The strings that stand one after another in ``data`` and end at ``ends``."""
    bound = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(bound), pa.py_buffer(np.ascontiguousarray(data)))


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings without nulls, and the bounds of each."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bound = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if bound[0] == bound[-1]:
        return np.zeros(0, np.uint8), bound - bound[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[bound[0] : bound[-1]], bound - bound[0]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words; where each ends in their bytes; the number of words from it to the end of its text."""
    data, bound = _strings(column)
    inside = ALNUM[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[bound] = True
    begins = begins[:-1]
    begins[1:] |= ~inside[:-1]
    starts = np.flatnonzero(begins & inside)
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    first = np.searchsorted(starts, bound)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))
    return _text(ends, data[inside]), ends, room


def _split(grams: pa.Array, n: int) -> pa.Array:
    """The words of n-grams of ``n`` words each."""
    data, bound = _strings(grams)
    spaces = np.flatnonzero(data == 32).reshape(len(grams), n - 1)
    ends = np.column_stack([spaces, bound[1:]]).ravel()
    before = np.add.outer(np.arange(len(grams)) * (n - 1), np.arange(n)).ravel()  # spaces before the end of each word
    return _text(ends - before, data[data != 32])


def _ranks(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its place among the distinct words in order, and these."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    ranks = np.empty(len(order), np.int32)
    ranks[order.to_numpy()] = np.arange(len(order))
    return ranks[coded.indices.to_numpy()], coded.dictionary.take(order)


def _summed(words: list[np.ndarray], top: int, seen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams in order, given and returned as a column of ranks below ``top`` for each word, and their sums."""
    key, size = words[0].astype(np.int64), top
    for word in words[1:]:
        if size * top >= KEYS:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * top + word, size * top
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    one = order[first]
    return [word[one] for word in words], np.add.reduceat(seen[order], first)


def _rows(words: list[np.ndarray], vocabulary: pa.Array, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(seen), BATCH_ROWS):
        part = slice(low, low + BATCH_ROWS)
        grams = pc.binary_join_element_wise(*[vocabulary.take(pa.array(word[part])) for word in words], SPACE)
        n = np.full(len(grams), len(words), np.int32)
        yield pa.record_batch({"n": n, "gram": grams.cast(pa.string()), "seen": seen[part]})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column in pieces of about the size of a chunk, or of one text if that is longer."""
    held: list[pa.Array] = []
    for batch in batches:
        column = batch.column(0).cast(pa.large_string())
        _, bound = _strings(column)
        cuts = np.unique([*np.searchsorted(bound, np.arange(0, bound[-1], CHUNK_BYTES)), len(column)])
        for low, high in pairwise(cuts):
            held.append(column[low:high])
            if sum(piece.nbytes for piece in held) >= CHUNK_BYTES:
                yield pa.concat_arrays(held)
                held = []
    if held:
        yield pa.concat_arrays(held)


def _counted(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts per chunk, batches of one length in order; n-grams one word below the longest only where no longest one begins."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _gathered(batches):
            words, ends, after = _words(column)
            size = int(ends[-1]) if len(ends) else 0
            cuts = np.unique(np.searchsorted(ends, np.arange(0, size + CHUNK_BYTES, CHUNK_BYTES), "right"))
            for low, high in pairwise(cuts):
                ranks, vocabulary = _ranks(words[low : high + longest - 1])
                room = after[low:high]
                for n in range(1, longest + 1):
                    at = np.flatnonzero(room == n if n == longest - 1 else room >= n)
                    if len(at):
                        grams, seen = _summed([ranks[at + k] for k in range(n)], len(vocabulary), np.ones(len(at), np.int64))
                        yield from _rows(grams, vocabulary, seen)
        pa.default_memory_pool().release_unused()  # idle workers stay

    return counted


def _packed(bounds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each range between bounds that has n-grams of a batch: these and their counts, compressed.

    A space comes before all letters and digits, so n-grams in order of their words are in order as strings.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", ZSTD_LEVEL)
        for batch in batches:
            grams, seen = batch["gram"], batch["seen"].to_numpy()
            low, high = (bisect_right(bounds, grams[k].as_py()) for k in (0, -1))
            cuts = [0, *(bisect_left(grams, bound, key=lambda gram: gram.as_py()) for bound in bounds[low:high]), len(grams)]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), grams), "\n")
            rows = []
            for part, (begin, end) in enumerate(pairwise(cuts), low):
                if begin < end:
                    data = seen[begin:end].tobytes() + joined[part - low].as_buffer()
                    rows.append((part, batch["n"][0].as_py(), end - begin, len(data), codec.compress(data, asbytes=True)))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, ["part", "n", "grams", "bytes", "packed"])

    return packed


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data = np.frombuffer(pa.decompress(row["packed"], row["bytes"], "zstd"), np.uint8)
            seen, grams = data[: 8 * row["grams"]].view(np.int64), data[8 * row["grams"] :]
            lines = np.append(np.flatnonzero(grams == 10), len(grams))
            gram = _text(lines - np.arange(len(lines)), grams[grams != 10]).cast(pa.string())
            yield pa.record_batch({"n": np.full(len(seen), row["n"], np.int32), "gram": gram, "seen": seen})


def _added(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the n-grams of a task, which has all that share their first words, from batches of one length each."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, list[pa.Array]] = {n: [] for n in range(1, longest + 1)}
        counts: dict[int, list[np.ndarray]] = {n: [np.zeros(0, np.int64)] for n in grams}
        for batch in batches:
            n = batch["n"][0].as_py()
            grams[n].append(_split(batch["gram"], n))
            counts[n].append(batch["seen"].to_numpy())
        if not any(grams.values()):
            return
        ranks, vocabulary = _ranks(pa.concat_arrays([words for of_length in grams.values() for words in of_length]))
        seen = {n: np.concatenate(counts[n]) for n in counts}
        del grams, counts
        ends = np.cumsum([n * len(seen[n]) for n in seen])[:-1]
        found = {n: list(part.reshape(-1, n).T) for n, part in zip(seen, np.split(ranks, ends), strict=True)}
        for n in range(longest, 0, -1):
            if len(seen[n]):
                words, sums = _summed(found.pop(n), len(vocabulary), seen.pop(n))
                yield from _rows(words, vocabulary, sums)
                if n == longest:
                    found[n - 1] = [np.concatenate(x) for x in zip(found[n - 1], words, strict=False)]
                    seen[n - 1] = np.concatenate([seen[n - 1], sums])
        pa.default_memory_pool().release_unused()  # idle workers stay

    return added
