"""Expressions over raw scholarly works with nested fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def rebuild_abstract(index: Column) -> Column:
    """Text from a word -> positions map; null when there is none.

    Gaps and empty words are skipped.  Where two entries claim one position the
    later map entry wins.
    """

    def placed(entry: Column, rank: Column) -> Column:
        return F.transform(
            entry["value"],
            lambda position: F.struct(
                position.alias("position"), rank.alias("rank"), entry["key"].alias("word")
            ),
        )

    def winners(places: Column) -> Column:
        return F.filter(
            places,
            lambda place, i: F.coalesce(
                F.get(places, i + 1)["position"] != place["position"], F.lit(True)
            )
            & (place["word"] != ""),
        )

    ordered = F.sort_array(F.flatten(F.transform(F.map_entries(index), placed)))
    text = F.array_join(F.transform(let(ordered, winners), lambda place: place["word"]), " ")
    return F.nullif(strip(text), F.lit(""))


def short_id(url: Column) -> Column:
    """Last path segment of an id URL without trailing slashes; '' gives null."""
    segment = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    return F.when(url != "", segment)


def display_names(entries: Column) -> Column:
    """Non-empty display names; null entries give an empty array."""
    names = F.filter(F.transform(entries, lambda e: e["display_name"]), lambda name: name != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def short_ids(entries: Column) -> Column:
    urls = F.filter(F.transform(entries, lambda e: e["id"]), lambda url: url != "")
    return F.coalesce(F.transform(urls, short_id), F.array().cast("array<string>"))


def primary_name(entries: Column) -> Column:
    """Name of the first entry, even if that name is null."""
    return F.get(entries, F.lit(0))["display_name"]


def work_title(title: Column, display_name: Column) -> Column:
    """First non-empty of the two, trimmed.  Emptiness is tested before the trim."""
    return strip(
        F.coalesce(F.nullif(title, F.lit("")), F.nullif(display_name, F.lit("")), F.lit(""))
    )
