"""Clean papers and keep the first of each set of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.shared import stored

UNIT_SEPARATOR = chr(31)


def clean_papers(
    papers: DataFrame, min_title_chars: int = 4, min_abstract_chars: int = 40
) -> DataFrame:
    """Collapse white space in title and abstract, then drop short ones.

    The pair is made and tested inside one generator.  As a plain projection
    followed by a filter, the optimizer would push the filter below the
    projection and clean every text twice.
    """
    pair = F.struct(collapse(F.col("title")).alias("title"),
                    collapse(F.col("abstract")).alias("abstract"))
    kept = F.filter(
        F.array(pair),
        lambda p: (F.length(p["title"]) >= min_title_chars)
        & (F.length(p["abstract"]) >= min_abstract_chars),
    )
    others = [c for c in papers.columns if c not in ("title", "abstract")]
    return papers.select(*others, F.inline(kept)).select(papers.columns)


def blank_id() -> Column:
    return F.trim(F.coalesce(F.col("id"), F.lit(""))) == ""


def id_gates(papers: DataFrame, by: str | None = None) -> DataFrame:
    """(table, filled): whether every row of a table has a non-blank id, which opens its dedup by id.

    One row per value of ``by`` (null is a value of its own), or one for all. Part of the
    plan: an aggregate of the id column, merged before the shuffle.
    """
    return papers.groupBy(table_of(by).alias("table")).agg(F.min(~blank_id()).alias("filled"))


def table_of(by: str | None) -> Column:
    """Name of the table that a row belongs to."""
    return F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))


def keep_first(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """First row, by ``seq``, of every combination of ``keys``.

    Repeats are merged before the shuffle as well as after it, so a key held by
    a third of all rows sends one row per map task.  Key columns are left out of
    the carried struct, so long texts used as keys travel once.
    """
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.col(seq)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(df.columns)


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """``df`` as it is, once every ``key`` in it is known to stand once; a repeated one is an error."""
    others = [c for c in df.columns if c != key]
    row = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(
        F.first(F.struct(*others)))
    return df.groupBy(key).agg(row.alias("row")).select(key, "row.*")


def with_content(papers: DataFrame) -> DataFrame:
    """Add ``content``, a SHA-256 of title and abstract that stands for both.

    Clean texts hold no unit separator, so the joined text is unambiguous.
    """
    joined = F.concat_ws(UNIT_SEPARATOR, "title", "abstract")
    return papers.withColumn("content", F.sha2(joined, 256))


def repeats(papers: DataFrame, gates: DataFrame, seq: str = "seq", by: str | None = None) -> DataFrame:
    """The ``seq`` of every row that repeats an earlier one of its table, as a stored table.

    First repeated ids go (where the table's gate is open), then repeated contents among the rest.
    Everything is decided on id, content hash and ``seq``; no text is shuffled.
    """
    marks = papers.select(table_of(by).alias("table"), "id", "content", seq)
    # in a table whose gate is closed every row is its own
    own = F.struct(F.when(F.col("filled"), F.col("id")).alias("id"), F.when(~F.col("filled"), F.col(seq)).alias("seq"))
    keyed = marks.join(gates, "table").withColumn("own", own)
    first = keyed.groupBy("table", "own").agg(F.min_by(F.struct("content", seq), F.col(seq)).alias("first"))
    kept = first.groupBy("table", "first.content").agg(F.min(f"first.{seq}").alias(seq))
    return stored(marks.select(seq).join(kept, seq, "left_anti"), "repeats")


def deduplicate(papers: DataFrame, seq: str = "seq", by: str | None = None) -> DataFrame:
    """Keep the first paper per id (if every id of the table is there), then per title and abstract.

    Adds ``row_key``, unique afterwards: the id, or the content hash where the table has blank ids.
    With ``by`` the rows of each of its values are a table of their own, with its own gate, and
    ``row_key`` begins with it. ``papers`` comes from ``with_content`` and should be
    stored: its narrow columns are read before the texts.  The repeats are taken out by an
    anti-join on ``seq``, which must be unique.  Their table has a measured size: small ones are
    broadcast, so the texts do not move at all; large ones cost one shuffle of
    the texts, by a key without hot values.
    """
    gates = stored(id_gates(papers, by), "id-gates")
    kept = papers.join(repeats(papers, gates, seq, by), seq, "left_anti")
    gates = gates.withColumnsRenamed({"table": "_table", "filled": "_filled"})
    key = F.when(F.col("_filled"), F.col("id")).otherwise(F.col("content"))
    named = key if by is None else F.concat_ws(UNIT_SEPARATOR, "_table", key)
    return kept.join(gates, table_of(by) == F.col("_table")).withColumn("row_key", named).drop("_table", "_filled")


def first_of_contents(papers: DataFrame, seq: str = "seq") -> DataFrame:
    """Keep the first paper per title and abstract, deciding on the content hash.

    ``papers`` comes from ``with_content`` and should be stored.
    """
    kept = papers.groupBy("content").agg(F.min(seq).alias(seq))
    later = stored(papers.select(seq).join(kept, seq, "left_anti"), "repeats")
    return papers.join(later, seq, "left_anti")
