"""Word stemming and common-subsequence length, the two per-row Python helpers.

Stemming follows Porter, "An algorithm for suffix stripping" (1980), with the
published later changes that the usual ROUGE tooling applies.  A stem depends on
its word alone and word frequencies are steep, so each Python worker keeps a
bounded cache: no vocabulary is shuffled, joined or broadcast.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STEM_FROM_LENGTH = 4  # fixed value: shorter words are left as they are

# Words that do not follow the rules.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement lists of the published algorithm.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
DOUBLE_SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
ENDINGS = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
RESIDUES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """One letter per character: v for vowels, c for consonants; y depends on its left."""
    shape = ""
    for char in word:
        vowel = char in "aeiou" or (char == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _ends_short(word: str) -> bool:
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _first_suffix(word: str, suffixes: list[str]) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


def _replace_first(word: str, rules: list[tuple[str, str]], least: int | None) -> str:
    """Apply the first rule whose suffix fits; its stem must reach ``least``."""
    table = dict(rules)
    suffix = _first_suffix(word, list(table))
    if suffix is None:
        return word
    stem = word.removesuffix(suffix)
    # the l of -logi counts towards its stem
    tested = stem + "l" if suffix == "logi" else stem
    return stem + table[suffix] if least is None or _measure(tested) >= least else word


def _past_and_gerund(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _first_suffix(word, ["ed", "ing"])
    stem = word.removesuffix(suffix) if suffix else ""
    if "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _shape(stem).endswith("c"):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_short(stem) else stem


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-2])
    return _replace_first(word, DOUBLE_SUFFIXES, least=1)


def _residue(word: str) -> str:
    suffix = _first_suffix(word, RESIDUES)
    stem = word.removesuffix(suffix) if suffix else word
    fits = suffix and _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st")
    return stem if fits else word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    """Stem of one lower-cased alphanumeric word."""
    if len(word) < STEM_FROM_LENGTH:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _replace_first(word, PLURALS, least=None)
    word = _past_and_gerund(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    word = _replace_first(_double_suffix(word), ENDINGS, least=1)
    return _tidy(_residue(word))


def _stemmed(joined: str | None) -> str | None:
    return None if joined is None else " ".join(map(stem_word, joined.split(" ")))


def stem_text(joined: Column) -> Column:
    """Stem every word of a text whose words are joined by single spaces."""

    @F.arrow_udf("string")
    def stem(texts: pa.Array) -> pa.Array:
        return pa.array((_stemmed(t.as_py()) for t in texts), pa.string())

    return stem(joined)


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence.

    One Python integer holds a row of the table as bits, so a step costs
    len(left) / 64 machine words instead of len(left) cells; whole documents
    stay affordable.
    """
    places: dict[str, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        hits = row & places.get(word, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(left) - row.bit_count()


def lcs_length(left: Column, right: Column) -> Column:
    """Longest common subsequence of two texts joined by single spaces."""

    @F.arrow_udf("int")
    def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((common_subsequence(x.as_py().split(), y.as_py().split()) for x, y in zip(a, b)), pa.int32())

    return lcs(left, right)


def stems_and_lcs(left: Column, right: Column) -> Column:
    """Struct (left, right, lcs): ``stem_text`` of both texts and ``lcs_length`` of the stems, in one Python pass."""

    @F.arrow_udf("struct<left:string,right:string,lcs:int>")
    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        stems = [pa.array((_stemmed(t.as_py()) for t in texts), pa.string()) for texts in (a, b)]
        lcs = pa.array((common_subsequence(x.as_py().split(), y.as_py().split()) for x, y in zip(*stems)), pa.int32())
        return pa.StructArray.from_arrays([*stems, lcs], names=["left", "right", "lcs"])

    return both(left, right)
