"""Periodic runs of words, by maximal pairs over LCP-interval trees.

A run is a stretch with period q, at least twice as long as q, that no neighbouring word
extends. Its words from the first on and from word q on are a maximal pair: two equal
stretches at distance q whose left words differ and whose right words differ. Conversely
a maximal pair of length l at distance d <= l whose second place is the next one at which
its l words stand is a run of length l + d with smallest period d, as it is: a smaller
period would put an occurrence of the l words in between.

1. Places are grouped by their first words, as many as the shortest maximal pair has
   (half the least length). A group whose left words are all one class has no pair that
   differs on the left, nor has any interval below it: it is left out.
2. The places of the other groups are put in suffix order with the lengths of their common
   prefixes (LCP), by comparing all with one place of their group at a time, on hashes of
   word sequences.
3. The tree of LCP intervals is built bottom-up from these lengths. An interval's places,
   in order, hold the class of their left words; where two children meet, neighbours of
   different children and different classes are the maximal pairs. The lists are kept by
   taking them apart from the root: the smaller child's places are unlinked from the
   list, so a place moves at most log2(n) times. Intervals of one class are skipped.

So a text of n words takes about n log n steps, whatever repeats in it. Hashes are 64 bits:
two different sequences are taken for equal with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship_package
from .words import U64, Texts, as_bytes, mix64, owner, powers, runs, windows

MIN_LENGTH = 12
TYPE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Sequences:
    """Word hashes of several texts end to end; text i is words first[i]:first[i + 1]."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.words, self.first = words, first
        self.text = owner(first)
        self.end = first[1:][self.text]
        self.up, self.down = powers(len(words) + 1)
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(words * self.up[: len(words)], dtype=U64)])
        # left word of each place; the first of a text has a class of its own
        self.left = np.concatenate([np.zeros(min(1, len(words)), U64), words[:-1]])
        begins = first[:-1][first[:-1] < first[1:]]
        self.left[begins] = mix64(begins.astype(U64) + U64(0x51ED27))

    def stretch(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[a + size] - self.total[a]) * self.down[a]

    def common(self, i: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Length of the common prefix from places i and j of one text; ``known`` words are alike."""
        low = known.copy()
        high = self.end[i] - np.maximum(i, j)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            half = (low[open_] + high[open_] + 1) // 2
            alike = self.stretch(i[open_], half) == self.stretch(j[open_], half)
            low[open_] = np.where(alike, half, low[open_])
            high[open_] = np.where(alike, high[open_], half - 1)

    def next_word(self, at: np.ndarray) -> np.ndarray:
        """Word at each place, 0 behind the end of a text (``at`` was reached from inside)."""
        return np.where(at < len(self.words), self.words[np.minimum(at, len(self.words) - 1)], U64(0))


def suffix_order(s: Sequences, places: np.ndarray, groups: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each group in suffix order, and the LCP of each with the one before it (0 at a group's start)."""
    at = places.copy()
    shared = np.zeros(len(at), np.int64)
    begin = np.concatenate([[True], groups[1:] != groups[:-1]])
    depth = np.full(len(at), known, np.int64)
    random = np.random.default_rng(0)
    far = np.int64(1) << 40
    while True:
        heads = np.flatnonzero(begin)
        sizes = np.diff(np.append(heads, len(at)))
        many = np.repeat(sizes > 1, sizes)
        if not many.any():
            return at, shared
        here = np.flatnonzero(many)
        heads, sizes = np.flatnonzero(begin[here]), sizes[sizes > 1]
        segment = np.repeat(np.arange(len(sizes)), sizes)
        pivot = at[here][heads + (random.random(len(sizes)) * sizes).astype(np.int64)][segment]
        own = at[here]
        lcp = s.common(own, pivot, depth[here])
        inside, pivot_inside = own + lcp < s.end[own], pivot + lcp < s.end[pivot]
        word, pivot_word = s.next_word(own + lcp), s.next_word(pivot + lcp)
        less = ~inside | pivot_inside & inside & (word < pivot_word)
        less &= pivot_inside  # a place that goes on where the pivot ends comes behind it
        side = np.where(own == pivot, far, np.where(less, lcp, 2 * far - lcp))
        order = np.lexsort((side, segment))
        side, lcp, segment = side[order], lcp[order], segment[order]
        at[here] = own[order]
        fresh = np.ones(len(here), bool)
        fresh[1:] = (side[1:] != side[:-1]) | (segment[1:] != segment[:-1])
        border = np.flatnonzero(fresh[1:] & (segment[1:] == segment[:-1])) + 1
        to_pivot = np.where(side == far, far, lcp)
        shared[here[border]] = np.minimum(to_pivot[border], to_pivot[border - 1])
        begin[here] = fresh
        depth[here] = lcp


def maximal_pairs(places: list[int], shared: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs with distance <= length and their sum at least ``least``.

    ``places`` in suffix order, ``shared`` their LCP with the one before, 0 where a group begins.
    """
    n = len(places)
    # bottom-up: the interval of border k reaches over all larger LCPs on both sides
    low, high, stack = [0] * n, [n] * n, []
    for k in range(n):
        while stack and shared[stack[-1]] > shared[k]:
            high[stack.pop()] = k
        low[k] = stack[-1] if stack else 0
        stack.append(k)
    changes = [0] * n
    for k in range(1, n):
        changes[k] = changes[k - 1] + (left[k] != left[k - 1])
    before, after = [-1] * n, [-1] * n
    starts = [k for k in range(n) if shared[k] == 0] + [n]

    def link(members: list[int]) -> None:
        for x, y in zip(members, members[1:], strict=False):
            after[x], before[y] = y, x
        before[members[0]] = after[members[-1]] = -1

    place = places.__getitem__
    for a, b in zip(starts, starts[1:], strict=False):
        link(sorted(range(a, b), key=place))
    found = []
    borders = sorted((k for k in range(n) if shared[k]), key=shared.__getitem__)  # parents first
    for k in borders:
        a, b, length = low[k], high[k], shared[k]
        if changes[a] == changes[b - 1]:
            continue
        small = sorted(range(a, k) if k - a <= b - k else range(k, b), key=place)
        one, other = (a, k) if k - a <= b - k else (k, b)
        for x in small:
            for y, z in ((before[x], x), (x, after[x])):
                outer = y if z == x else z
                if outer < 0 or one <= outer < other:
                    continue
                distance = places[z] - places[y]
                if distance <= length and distance + length >= least and left[y] != left[z]:
                    found.append((places[y], distance, length))
        for x in small:
            p, q = before[x], after[x]
            if p >= 0:
                after[p] = q
            if q >= 0:
                before[q] = p
        link(small)
    return found


def word_runs(words: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``least`` words or more, by text, start and period."""
    shortest = max(1, -(-least // 2))
    s = Sequences(words, first)
    none = np.zeros((0, 4), np.int64)
    at = np.flatnonzero(np.arange(len(words)) + shortest <= s.end)
    if len(at) < 2:
        return none
    keys = windows(words, shortest)[at] ^ mix64(s.text[at].astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    classes = s.left[at]
    mixed = np.minimum.reduceat(classes, heads) != np.maximum.reduceat(classes, heads)
    sizes = np.diff(np.append(heads, len(at)))
    use = np.repeat(mixed, sizes)
    if not use.any():
        return none
    places, shared = suffix_order(s, at[use], np.repeat(np.arange(len(heads)), sizes)[use], shortest)
    pairs = maximal_pairs(places.tolist(), shared.tolist(), s.left[places].tolist(), least)
    if not pairs:
        return none
    start, period, length = np.array(pairs, np.int64).T
    text = s.text[start]
    rows = np.stack([text, start - first[text], length + period, period], 1)
    return rows[np.lexsort((period, rows[:, 1], text))]


def _analysed(least: int):
    def analysed(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts.cast(pa.binary()))
        counts, found, collapsed = [], [np.zeros((0, 4), np.int64)], []
        for a, b in runs(rows):
            t = Texts(rows[a:b])
            these = word_runs(t.words(), t.first, least)
            steps = np.zeros(len(t.starts) + 1, np.int64)
            at = t.first[these[:, 0]] + these[:, 1]
            np.add.at(steps, at + these[:, 3], 1)
            np.add.at(steps, at + these[:, 2], -1)
            kept = np.cumsum(steps[:-1]) == 0
            touched = set(these[:, 0].tolist())
            for i in range(b - a):
                words = rows[a + i].split()
                if i in touched:
                    words = [w for w, k in zip(words, kept[t.first[i] : t.first[i + 1]].tolist(), strict=True) if k]
                collapsed.append(b" ".join(words).decode())
            counts.append(np.diff(t.first))
            these[:, 0] += a
            found.append(these)
        flat = np.concatenate(found)
        offsets = np.searchsorted(flat[:, 0], np.arange(len(rows) + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.ListArray.from_arrays(pa.array(offsets), structs),
             pa.array(collapsed, pa.string())], names=["n_words", "runs", "collapsed"])

    return F.arrow_udf(analysed, TYPE).asNondeterministic()


def periodic_runs(text: str | Column = "text", least: int = MIN_LENGTH) -> Column:
    """Struct of a text's number of words, its runs by start and period, and the collapsed text.

    Runs have ``least`` words or more and at least two periods; starts are word numbers
    from 0. Collapsed: the words that no run contains after its first period, joined by
    one space. Words are compared as they are, letter case included. Null and empty texts
    have no words, no runs and an empty collapsed text. Texts of any length are taken whole.
    """
    column = F.col(text) if isinstance(text, str) else text
    return _analysed(least)(column)


def collapse_runs(docs: DataFrame, text: str = "text", result: str = "periodic", least: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the struct of ``periodic_runs`` in ``result`` (replaced if there), all other columns and rows kept."""
    ship_package(docs.sparkSession)
    return docs.withColumn(result, periodic_runs(text, least))


def repeat_tails(key: str | Column, text: str | Column) -> Column:
    """The text, with the tail of one key in ten made periodic, as words joined by one space.

    With h the CRC-32 of the key's decimal digits (a null key: of ''), g = h // 10 and n
    words: if h ends in 0, each word i >= a becomes word a + (i - a) % p, where a = g % n
    and p = 1 + (n - a) // (3 + g % 8). Other texts stay as they are; a null text is empty.
    """
    def repeated(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for h, raw in zip(hashes.to_pylist(), as_bytes(texts), strict=True):
            if h % 10 == 0 and (words := raw.split()):
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                cycle = words[a : a + p]
                whole = cycle * (-(-(n - a) // p))
                raw = b" ".join(words[:a] + whole[: n - a])
            out.append(raw)
        return pa.array(out, pa.binary())

    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    digits = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.arrow_udf(repeated, "binary").asNondeterministic()(F.crc32(digits), text.cast("binary"))
