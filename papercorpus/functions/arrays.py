"""Expressions over word arrays: n-grams, set and multiset overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKUP_PRODUCT = 1 << 14  # length product up to which looking elements up is cheaper

def longer_ngrams(grams: Column, tokens: Column, n: int) -> Column:
    """The n-grams of ``tokens`` from its (n-1)-grams, by zipping on one more word.

    Words hold no space, so a joined n-gram is unambiguous.
    """
    length = ngram_count(tokens, n)
    return F.zip_with(
        F.slice(grams, F.lit(1), length),
        F.slice(tokens, F.lit(n), length),
        lambda gram, word: F.concat(gram, F.lit(" "), word),
    )


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of ``tokens`` (an attribute, not a costly expression)."""
    grams = tokens
    for size in range(2, n + 1):
        grams = longer_ngrams(grams, tokens, size)
    return grams


def tagged(items: Column, n: int) -> Column:
    """Elements as structs (n, gram)."""
    return F.transform(items, lambda i: F.struct(F.lit(n).alias("n"), i.alias("gram")))


def tagged_ngrams(tokens: Column, n: int) -> Column:
    return tagged(ngrams(tokens, n), n)


def ngram_count(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two word sets; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def clipped_overlap(left: Column, right: Column) -> Column:
    """Sum over distinct elements of the smaller of the two counts.

    Short pairs look each shared element up in both arrays.  That costs the
    product of the lengths, so longer pairs are sorted and folded instead; both
    ways give the same number, and rows without a shared element need neither.
    """
    short = F.size(left).cast("long") * F.size(right) <= LOOKUP_PRODUCT
    counted = F.when(short, _overlap_by_lookup(left, right)).otherwise(
        _overlap_by_sorting(left, right)
    )
    return F.when(F.arrays_overlap(left, right), counted).otherwise(0)


def _overlap_by_lookup(left: Column, right: Column) -> Column:
    def count(items: Column, item: Column) -> Column:
        return F.size(items) - F.size(F.array_remove(items, item))

    return F.aggregate(
        F.array_intersect(left, right),
        F.lit(0),
        lambda total, item: total + F.least(count(left, item), count(right, item)),
    )


def _overlap_by_sorting(left: Column, right: Column) -> Column:
    """Tag both arrays, sort them together and fold run by run."""

    def sided(items: Column, side: int) -> Column:
        return F.transform(
            items, lambda item: F.struct(item.alias("item"), F.lit(side).alias("side"))
        )

    def step(state: Column, entry: Column) -> Column:
        same = state["item"] == entry["item"]
        return F.struct(
            entry["item"].alias("item"),
            (F.when(same, state["left"]).otherwise(0) + 1 - entry["side"]).alias("left"),
            (F.when(same, state["right"]).otherwise(0) + entry["side"]).alias("right"),
            (
                state["total"]
                + F.when(same, 0).otherwise(F.least(state["left"], state["right"]))
            ).alias("total"),
        )

    start = F.struct(
        F.lit("").alias("item"),
        F.lit(0).alias("left"),
        F.lit(0).alias("right"),
        F.lit(0).alias("total"),
    )
    runs = F.sort_array(F.concat(sided(left, 0), sided(right, 1)))
    return F.aggregate(runs, start, step, lambda s: s["total"] + F.least(s["left"], s["right"]))


def mask_labels(ids: Column, pad: int, ignored: int = -100) -> Column:
    """Replace the ignored label id by the padding id."""
    return F.transform(ids, lambda i: F.when(i == ignored, F.lit(pad)).otherwise(i))
