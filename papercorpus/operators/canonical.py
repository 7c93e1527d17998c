"""Map the accepted input layouts to one canonical paper table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Canonical columns and the column names of the input layouts.
CANONICAL = ["id", "title", "abstract", "publication_year", "topics", "primary_topic"]
OPTIONAL = ["publication_year", "topics", "primary_topic"]
LEGACY_REQUIRED = ["openalex_id", "title", "abstract"]
LEGACY_OPTIONAL = {
    "publication_year": "publication_year", "topic_ids": "topics", "primary_topic": "primary_topic",
}
CAPITALISED_REQUIRED = ["Title", "Abstract"]
CAPITALISED_OPTIONAL = {"Category": "primary_topic"}
LAYOUTS = ("standard", "legacy_works", "capitalised")


def detect_layout(
    columns: Iterable[str], id_column: str = "id", title_column: str = "title",
    abstract_column: str = "abstract",
) -> str | None:
    """Layout a set of column names belongs to, the most specific one first."""
    names = set(columns)
    if names.issuperset(LEGACY_REQUIRED) and id_column not in names:
        return "legacy_works"
    if names.issuperset([title_column, abstract_column]):
        return "standard"
    if names.issuperset(CAPITALISED_REQUIRED):
        return "capitalised"
    return None


def resolve_layout(requested: str, detected: str | None) -> str:
    """Layout to use; unknown, undetectable and contradicting requests are errors."""
    if requested != "auto" and requested not in LAYOUTS:
        raise ValueError(f"unknown layout {requested!r}; known: auto, {', '.join(LAYOUTS)}")
    if requested == "auto":
        if detected is None:
            raise ValueError("no known layout fits the columns; name one explicitly")
        return detected
    if detected not in (None, requested):
        raise ValueError(f"layout {requested!r} requested, but the columns are {detected!r}")
    return requested


def canonicalise(
    raw: DataFrame,
    layout: str = "auto",
    id_column: str = "id",
    title_column: str = "title",
    abstract_column: str = "abstract",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One projection to the canonical columns; ``carry`` passes others through.

    Only column names are looked at, so no job runs.
    """
    detected = detect_layout(raw.columns, id_column, title_column, abstract_column)
    chosen = resolve_layout(layout, detected)
    if chosen == "legacy_works":
        sources, optional = LEGACY_REQUIRED, LEGACY_OPTIONAL
    elif chosen == "capitalised":
        sources, optional = [None, *CAPITALISED_REQUIRED], CAPITALISED_OPTIONAL
    else:
        key = id_column if id_column in raw.columns else None
        sources, optional = [key, title_column, abstract_column], {c: c for c in OPTIONAL}
    missing = [c for c in sources if c is not None and c not in raw.columns]
    if missing:
        raise ValueError(f"layout {chosen!r} lacks required columns: {missing}")
    required = [
        (F.lit("") if source is None else F.col(source).cast("string")).alias(name)
        for source, name in zip(sources, CANONICAL)
    ]
    found = [F.col(s).alias(name) for s, name in optional.items() if s in raw.columns]
    return raw.select(*required, *found, *carry)


def canonical_columns(df: DataFrame) -> DataFrame:
    return df.select([c for c in CANONICAL if c in df.columns])
