"""Text expressions.  All of them are Spark built-ins, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space in the title and
# abstract rules (tab to carriage return, the four separators, space, and the
# Unicode spaces).  Plain Java \s knows only six of them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Patterns of the word, title and slug rules.
WORD = "[A-Za-z0-9]+"
QUOTES = "\"'`"
TITLE_PREFIX = "(?i)^ *title *: *"
NOT_SLUG = "[^a-z0-9_-]+"
SLUG_CHARS = 80
SLUG_FALLBACK = "query"

# The steps of the 13a tokenisation used for BLEU.
BLEU_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
BLEU_SPACING = [
    (r"([\{-~\[-` -&\(-+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def collapse(text: Column) -> Column:
    """White-space runs become one space, ends are trimmed, null becomes ''.

    ``translate`` first and a literal-space regex after it runs about twice as
    fast as one regex over the whole class.
    """
    filled = F.coalesce(text.cast("string"), F.lit(""))
    return _squeeze(F.translate(filled, WHITESPACE, " " * len(WHITESPACE)))


def strip(text: Column) -> Column:
    """Trim white space at both ends only; null becomes ''."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def slug(text: Column) -> Column:
    joined = F.replace(collapse(F.lower(text)), F.lit(" "), F.lit("_"))
    kept = F.substring(F.regexp_replace(joined, NOT_SLUG, ""), 1, SLUG_CHARS)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(SLUG_FALLBACK))


def first_words(text: Column, count: int) -> Column:
    """First ``count`` words of a collapsed text; no limit when not positive."""
    if count <= 0:
        return text
    return F.array_join(F.slice(F.split(text, " "), 1, count), " ")


def clean_title(raw: Column, max_words: int = 15) -> Column:
    """Turn raw model output into a title.

    The order is part of the rule: quotes go before the ``title:`` prefix, so a
    quote behind the prefix stays.
    """
    unquoted = F.trim(F.trim(collapse(raw), F.lit(QUOTES)))
    return first_words(F.trim(F.regexp_replace(unquoted, TITLE_PREFIX, "")), max_words)


def rouge_text(text: Column) -> Column:
    """Lower-cased words joined by single spaces, everything else dropped."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def bleu_text(text: Column) -> Column:
    """13a tokens joined by single spaces; letter case is kept."""
    out = F.replace(collapse(text), F.lit("<skipped>"), F.lit(""))
    for entity, char in BLEU_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.concat(F.lit(" "), F.rtrim(out), F.lit(" "))
    for pattern, replacement in BLEU_SPACING:
        out = F.regexp_replace(out, pattern, replacement)
    return _squeeze(out)


def split_words(joined: Column) -> Column:
    """Words of a text already joined by single spaces; '' has none."""
    return F.filter(F.split(joined, " "), lambda word: word != "")  # ``joined`` stands once in the plan
