"""The library's text rules as SQL functions.

Each function is a column expression of the other modules as the body of a temporary SQL
function, so a query in SQL text is planned with the same built-ins as the DataFrame call: no
Python worker runs, and filters and column pruning pass through it.

Table functions yield the n-grams of an array of words and the words of an inverted index, one
row each, for lateral joins. ``index_rows`` is SQL. ``gram_rows`` runs in Python, a hundred rows at a
time: an Arrow batch is ten thousand, which as lists of words take gigabytes in every worker. Spark
takes columns, but no SQL function's call, as their arguments, so call that in a subquery. The columns of
``gram_rows`` follow from its second argument when the query is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.shared import ship_package
from .prompts import INSTRUCTION, ROLE, RULES
from .text import (
    BLEU_ENTITIES, BLEU_SPACING, NOT_SLUG, QUOTES, SLUG_CHARS, SLUG_FALLBACK, TITLE_PREFIX, WHITESPACE, WORD,
)


def literal(text: str) -> str:
    """A SQL string that stands for ``text``, whatever it holds."""
    return "'" + "".join(c if " " <= c <= "~" and c not in "'\\" else f"\\u{ord(c):04x}" for c in text) + "'"


_SPACES = literal(WHITESPACE)
_LAST_SEGMENT = "case when {0} <> '' then substring_index(rtrim('/', {0}), '/', -1) end"
_ENTRIES = "array<struct<id: string, display_name: string>>"


def _bleu_body() -> str:
    body = "replace(collapse_text(x), '<skipped>', '')"
    for entity, char in BLEU_ENTITIES:
        body = f"replace({body}, {literal(entity)}, {literal(char)})"
    body = f"concat(' ', rtrim({body}), ' ')"
    for pattern, replacement in BLEU_SPACING:
        body = f"regexp_replace({body}, {literal(pattern)}, {literal(replacement)})"
    return f"trim(regexp_replace({body}, ' {{2,}}', ' '))"


# Signature, type and body of each function; a later one may call an earlier one, but not on a lambda's variable.
FUNCTIONS = [
    ("collapse_text(x string)", "string",
     f"trim(regexp_replace(translate(coalesce(x, ''), {_SPACES}, '{' ' * len(WHITESPACE)}'), ' {{2,}}', ' '))"),
    ("strip_text(x string)", "string", f"trim(both {_SPACES} from coalesce(x, ''))"),
    ("alnum_words(x string)", "array<string>", f"regexp_extract_all(lower(coalesce(x, '')), {literal(WORD)}, 0)"),
    ("alnum_word_count(x string)", "int", "size(alnum_words(x))"),
    ("text_slug(x string)", "string",
     f"coalesce(nullif(substring(regexp_replace(replace(collapse_text(lower(x)), ' ', '_'), {literal(NOT_SLUG)}, ''), 1, {SLUG_CHARS}), ''),"
     f" {literal(SLUG_FALLBACK)})"),
    ("first_words(x string, n int)", "string", "if(n <= 0, x, array_join(slice(split(x, ' '), 1, greatest(n, 1)), ' '))"),
    ("clean_title(x string, n int default 15)", "string",
     f"first_words(trim(regexp_replace(trim(trim(both {literal(QUOTES)} from collapse_text(x))), {literal(TITLE_PREFIX)}, '')), n)"),
    ("rouge_text(x string)", "string", "trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' '))"),
    ("bleu_text(x string)", "string", _bleu_body()),
    ("word_ngrams(words array<string>, n int)", "array<string>",
     "if(n < 1 or size(words) < n, cast(array() as array<string>),"
     " transform(sequence(1, greatest(size(words) - n + 1, 1)), i -> array_join(slice(words, i, greatest(n, 1)), ' ')))"),
    ("word_jaccard(a array<string>, b array<string>)", "double",
     "if(size(array_union(a, b)) = 0, 1.0D, size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0))"),
    ("short_id(url string)", "string", _LAST_SEGMENT.format("url")),
    (f"display_names(entries {_ENTRIES})", "array<string>",
     "coalesce(filter(transform(entries, e -> e.display_name), n -> n <> ''), cast(array() as array<string>))"),
    (f"short_ids(entries {_ENTRIES})", "array<string>",
     "coalesce(transform(filter(transform(entries, e -> e.id), u -> u <> ''), u -> " + _LAST_SEGMENT.format("u") + "),"
     " cast(array() as array<string>))"),
    (f"primary_name(entries {_ENTRIES})", "string", "get(entries, 0).display_name"),
    ("work_title(title string, display_name string)", "string",
     "strip_text(coalesce(nullif(title, ''), nullif(display_name, ''), ''))"),
    ("rebuild_abstract(index map<string, array<int>>)", "string",
     "nullif(strip_text(array_join(transform(transform(array(sort_array(flatten(transform(map_entries(index), (e, r) ->"
     " transform(e.value, p -> named_struct('position', p, 'rank', r, 'word', e.key)))))), places ->"
     " filter(places, (p, i) -> p.word <> '' and coalesce(get(places, i + 1).position <> p.position, true)))[0],"
     " p -> p.word), ' ')), '')"),
    (f"seq2seq_prompt(abstract string, instruction string default {literal(INSTRUCTION)})", "string",
     f"concat(instruction, {literal(chr(10) * 2)}, abstract)"),
    (f"title_prompt(abstract string, instruction string default {literal(INSTRUCTION)})", "string",
     f"concat_ws({literal(chr(10))}, {', '.join([literal(ROLE), 'collapse_text(instruction)', *map(literal, RULES)])},"
     " concat('Abstract: ', collapse_text(abstract)), 'Title:')"),
    ("mask_labels(ids array<int>, pad int, ignored int default -100)", "array<int>",
     "transform(ids, i -> case when i = ignored then pad else i end)"),
]


class GramRows:
    """(position, gram, word_1 ... word_n) of each n-gram of an array of words; n is a constant."""

    @staticmethod
    def analyze(words: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(words.dataType, ArrayType):
            raise ValueError("the first argument must be an array of words")
        if not n.isConstantExpression or not isinstance(n.value, int) or n.value < 1:
            raise ValueError("the length of n-grams must be a constant of at least 1")
        schema = StructType().add("position", IntegerType()).add("gram", StringType())
        for k in range(1, n.value + 1):
            schema = schema.add(f"word_{k}", StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, words: list[str] | None, n: int) -> Iterator[tuple]:
        words = words or []
        for i in range(len(words) - n + 1):
            gram = words[i : i + n]
            yield i, " ".join(gram), *gram


# (position, word) of a word -> positions map, one row a position; the later map entry wins a position.
INDEX_ROWS = """index_rows(index map<string, array<int>>) returns table(position int, word string) return
    select entry.position, entry.word from (select explode(transform(array(sort_array(flatten(transform(filter(map_entries(index),
      e -> e.value is not null), (e, r) -> transform(filter(e.value, p -> p is not null), p -> named_struct('position', p, 'rank', r, 'word', e.key)))))),
      places -> filter(places, (p, i) -> p.word <> '' and coalesce(get(places, i + 1).position <> p.position, true)))[0]) as entry)"""


TABLE_FUNCTIONS = {"gram_rows": GramRows}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; their names."""
    ship_package(spark)
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {signature} returns {kind} return {body}")
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, useArrow=False))
    spark.sql(f"create or replace temporary function {INDEX_ROWS}")
    return [signature.partition("(")[0] for signature, _, _ in FUNCTIONS] + [*TABLE_FUNCTIONS, "index_rows"]
