"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of the words give all n-grams of several lengths; those found twice or
more in a text cover characters, and the covered share of each length has a limit.
An n-gram can only repeat where its first ``LENGTHS[0]`` words repeat, so only the
shortest length is sorted over all words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship_package
from .scratch import spare
from .words import U64, Texts, as_bytes, mix64, owner, runs, windows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Length in words -> largest share of word characters inside repeated runs of that length.
LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
LINE_LIMIT = 0.30
MIN_WORDS = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
COVERS = [f"chars_in_{n}" for n in LIMITS]
TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS + COVERS) + ">"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of COUNTS + COVERS per text."""
    t = Texts(texts)
    out = np.zeros((len(texts), len(COUNTS) + len(COVERS)), np.int64)
    points = t.code_points()
    symbols = t.count(_symbol[t.buf])
    sizes = points[t.ends] - points[t.starts]  # code points of each word
    total = np.concatenate([[0], np.cumsum(sizes)])
    out[:, 0] = np.diff(t.first)
    out[:, 1] = np.diff(total[t.first])
    out[:, 2] = np.diff(symbols[t.bound])

    begin, end, first_line = t.lines()
    filled = np.searchsorted(t.starts, end) > np.searchsorted(t.starts, begin)
    line_owner = owner(first_line)[filled]
    keys = t.hashes(begin[filled], end[filled]) ^ mix64(line_owner.astype(U64) + U64(1))
    _, kept = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[kept] = False
    in_words = np.searchsorted(t.starts, end[filled][later]), np.searchsorted(t.starts, begin[filled][later])
    out[:, 3] = np.bincount(line_owner[later], minlength=len(texts))
    np.add.at(out[:, 5], line_owner[later], total[in_words[0]] - total[in_words[1]])

    words, word_owner = t.words(), owner(t.first)
    salt = mix64(word_owner.astype(U64) + U64(1))
    last = t.first[1:][word_owner]  # end of the words of the same text
    at = np.arange(len(words))
    for k, n in enumerate(LIMITS):
        at = at[at + n <= last[at]]
        if not len(at):
            break
        hashed = windows(words, n)[at] if k == 0 else _windows_at(words, at, n)
        at = at[repeated(hashed ^ salt[at])]
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
        inside = np.cumsum(steps[:-1]) > 0
        chars = np.concatenate([[0], np.cumsum(sizes * inside)])
        out[:, len(COUNTS) + k] = np.diff(chars[t.first])
        if n == WINDOW:
            covered = np.concatenate([[0], np.cumsum(inside)])
            out[:, 4] = np.diff(covered[t.first])
    return out


def _windows_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = words[at].copy()
    for k in range(1, n):
        total = mix64(total) + words[at + k]
    return mix64(total)


def _measured(texts: pa.Array) -> pa.Array:
    rows = as_bytes(texts)
    parts = [measure(rows[a:b]) for a, b in runs(rows)]
    table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS) + len(COVERS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=COUNTS + COVERS)


def repetition(text: str | Column = "text") -> Column:
    """Struct of counts and covered characters of a text; null and empty texts have zeros.

    A repeated run counts with its first occurrence; a repeated line without it. Words
    of any length and texts of any length are taken whole, one text at a time at least.
    """
    def measured(texts: pa.Array) -> pa.Array:
        return _measured(texts)

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(measured, TYPE).asNondeterministic()(column.cast("binary"))


def judge(docs: DataFrame, text: str = "text", result: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``result``: the measures, base_failed and kept.

    Every row stays with its other columns, whatever their names (a column called as
    ``result`` is replaced). ``base_failed``: fewer than 20 words, or more than 30 % of
    the words in repeated 8-word windows. ``kept``: not that, and no covered share above
    its limit in LIMITS or LINE_LIMIT. Null and empty texts have no words and fail.
    """
    ship_package(docs.sparkSession)
    measured = docs.withColumn(result, repetition(text))
    m = F.col(result)
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    over = m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for name, limit in zip(COVERS, LIMITS.values(), strict=True):
        over |= m[name] > limit * m["word_chars"]
    return measured.withColumn(result, F.struct(f"`{result}`.*", base.alias("base_failed"),
                                                (~base & ~over).alias("kept")))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents the rules keep, with their own columns."""
    verdict = spare("_quality", docs)
    return judge(docs, text, verdict).filter(F.col(verdict)["kept"]).drop(verdict)
