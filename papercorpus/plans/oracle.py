"""The catalog's results as SQL for an independent engine (DuckDB dialect).

Written from the definitions, with other means than the Spark plans: plain
window ranks instead of cut points, joined n-gram counts instead of folds, a
regex chain instead of the Python stemmer, a table row of the common-subsequence
recurrence instead of bit vectors.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from ..functions import prompts, stemming
from ..functions.text import (
    BLEU_ENTITIES, BLEU_SPACING, NOT_SLUG, QUOTES, SLUG_CHARS, SLUG_FALLBACK,
)
from ..operators.canonical import CANONICAL
from ..operators.quality import ROW_METRICS

# fixed value: the white space of the text rules as a regex class
WS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SITE = "https://example.org"
SEED = 42
ORACLES: dict[str, str] = {}


# --- expressions ---------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+\z', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[A-Za-z0-9]+')"


def first_line(x: str = "text") -> str:
    return f"split_part({x}, chr(10), 1)"


def split_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def rouge_text(x: str) -> str:
    return f"trim(regexp_replace(lower({collapse(x)}), '[^a-z0-9]+', ' ', 'g'))"


def bleu_text(x: str) -> str:
    out = f"replace({collapse(x)}, '<skipped>', '')"
    for entity, char in BLEU_ENTITIES:
        out = f"replace({out}, {lit(entity)}, {lit(char)})"
    out = f"' ' || rtrim({out}) || ' '"
    for pattern, replacement in BLEU_SPACING:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def clean_title(raw: str, max_words: int) -> str:
    quotes = lit(f"^[{QUOTES}]+|[{QUOTES}]+$")
    unquoted = f"trim(regexp_replace({collapse(raw)}, {quotes}, '', 'g'))"
    title = f"trim(regexp_replace({unquoted}, '^ *title *: *', '', 'i'))"
    return first_words(title, max_words) if max_words > 0 else title


def first_words(x: str, n: int) -> str:
    return f"array_to_string(string_split({x}, ' ')[1:{n}], ' ')"


def slug(x: str) -> str:
    kept = f"regexp_replace(replace({collapse(f'lower({x})')}, ' ', '_'), '{NOT_SLUG}', '', 'g')"
    return f"coalesce(nullif(substring({kept}, 1, {SLUG_CHARS}), ''), '{SLUG_FALLBACK}')"


def short_id(x: str) -> str:
    return rf"CASE WHEN {x} <> '' THEN regexp_extract(rtrim({x}, '/'), '([^/]*)\z', 1) END"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def ascii_upper(x: str) -> str:
    return f"translate({x}, '{ascii_lowercase}', '{ascii_uppercase}')"


def order_key(salt: str, key: str) -> str:
    return f"md5('{SEED}:{salt}:' || {key}) || ':' || {key}"


def cosine(a: str, b: str) -> str:
    norm_a, norm_b = (f"greatest(sqrt(list_dot_product({v}, {v})), 1e-12)" for v in (a, b))
    return f"list_dot_product({a}, {b}) / ({norm_a} * {norm_b})"


def query(**parts: str) -> str:
    """WITH parts..., the last one being the result."""
    *tables, (_, final) = parts.items()
    if not tables:
        return final
    bodies = ",\n".join(f"{name} AS ({sql})" for name, sql in tables)
    recursive = "RECURSIVE " if any("UNION ALL /*step*/" in sql for _, sql in tables) else ""
    return f"WITH {recursive}{bodies}\n{final}"


# --- derived inputs ------------------------------------------------------------

PAPERS = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {first_line()} AS title, text AS abstract,
       CAST(doc_id % 25 + 2000 AS BIGINT) AS publication_year, source AS topics,
       lang AS primary_topic, doc_id AS seq
FROM documents"""


def clean(source: str, min_title: int = 4, min_abstract: int = 40) -> str:
    return f"""
SELECT * FROM (SELECT * REPLACE ({collapse('title')} AS title, {collapse('abstract')} AS abstract)
               FROM {source})
WHERE length(title) >= {min_title} AND length(abstract) >= {min_abstract}"""


def keep_first(source: str, *keys: str) -> str:
    return f"""
SELECT * FROM {source}
QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY seq) = 1"""


LINK = f"'{SITE}/works/W' || (doc_id // 3) || CASE WHEN (doc_id // 3) % 5 = 0 THEN '/' ELSE '' END"
WORKS = f"""
SELECT doc_id AS seq, text,
  CASE WHEN doc_id % 89 = 7 THEN '' WHEN doc_id % 97 <> 13 THEN {LINK} END AS id,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN {first_line()} END AS title,
  {first_line()} AS display_name,
  doc_id % 23 <> 0 AS has_index,
  CAST(doc_id % 25 + 2000 AS BIGINT) AS publication_year,
  DATE '2019-01-01' + CAST(doc_id % 2500 AS INTEGER) AS publication_date,
  CASE WHEN doc_id % 17 <> 0 THEN [source, lang] END AS topic_keys,
  CASE WHEN doc_id % 17 <> 0
       THEN [CASE WHEN doc_id % 19 <> 0 THEN source END, lang] END AS topic_labels,
  [lang] AS concept_keys
FROM documents"""
NORMAL = f"""
SELECT seq, {short_id('id')} AS id,
  {strip("coalesce(nullif(title, ''), nullif(display_name, ''), '')")} AS title,
  CASE WHEN has_index THEN {collapse('text')} ELSE '' END AS abstract,
  publication_year,
  {joined("list_filter(topic_labels, lambda t: t IS NOT NULL)")} AS topics,
  topic_labels[1] AS primary_topic
FROM works"""

SPLIT_WORDS = f"SELECT *, string_split({collapse('text')}, ' ') AS w FROM documents"
RUNS = """
SELECT *, 'lead' AS run, array_to_string(w[1:12], ' ') AS shown FROM split_words
UNION ALL
SELECT *, 'tail' AS run, array_to_string(w[greatest(len(w) - 9, 1):], ' ') AS shown
FROM split_words"""
SCORED = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, run,
  CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 7 = 0 THEN {ascii_upper('shown')} ELSE shown END
    AS prediction,
  {collapse(first_line())} AS reference, text AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split
FROM runs"""
SCORED_PARTS = {"split_words": SPLIT_WORDS, "runs": RUNS, "scored": SCORED}
LEAD = """
SELECT run || '-' || id AS id, abstract, reference AS title, prediction AS predicted_title, split
FROM scored"""
DIALOGUES = """
SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS reference, u.text AS abstract
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE a.role = 'assistant' AND u.role = 'user'"""
PAIRS = """
SELECT a.vec_id, a.label, CAST(a.embedding AS DOUBLE[]) AS p, CAST(b.embedding AS DOUBLE[]) AS r
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


# --- splits and samples --------------------------------------------------------


def quotas(strata: str, draws: str) -> str:
    return f"""
SELECT stratum, size, CAST(base + CASE WHEN row_number() OVER (
         ORDER BY remainder DESC, size DESC, {order_key('tie', 'stratum')})
         <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
FROM (SELECT stratum, size, draws, size * draws // total AS base, size * draws % total AS remainder
      FROM (SELECT stratum, CAST(size AS HUGEINT) AS size, CAST({draws} AS HUGEINT) AS draws,
                   CAST(sum(size) OVER () AS HUGEINT) AS total FROM {strata}))"""


def cut(name: str, source: str, fraction: float, salt: str, key: str, column: str | None) -> dict:
    """CTEs marking the first part of ``source`` in a column called ``name``."""
    stratum = "''" if column is None else f"coalesce(CAST({column} AS VARCHAR), '__NA__')"
    flag = "false" if column is None else "count(*) >= 2 AND min(size) >= 2"
    draws = f"(SELECT CAST(floor({fraction!r}::DOUBLE * count(*)) AS BIGINT) FROM {source})"
    return {
        f"{name}_strata": f"SELECT {stratum} AS stratum, count(*) AS size FROM {source} GROUP BY 1",
        f"{name}_gate": f"SELECT {flag} AS open FROM {name}_strata",
        f"{name}_quotas": quotas(f"{name}_strata", draws),
        f"{name}_ranked": f"""
SELECT *, row_number() OVER (ORDER BY {order_key(salt, key)}) AS place,
  row_number() OVER (PARTITION BY {stratum} ORDER BY {order_key(salt, key)}) AS place_inside,
  {stratum} AS stratum FROM {source}""",
        f"{name}_marked": f"""
SELECT r.* EXCLUDE (place, place_inside, stratum),
  CASE WHEN (SELECT open FROM {name}_gate) THEN place_inside <= quota
       ELSE place <= {draws} END AS {name}
FROM {name}_ranked r JOIN {name}_quotas q ON r.stratum = q.stratum""",
    }


def split(
    source: str, key: str, column: str | None, train: float = 0.8, val: float = 0.1,
    test: float = 0.1,
) -> dict:
    """CTEs ending in ``split_table``."""
    return {
        **cut("train", source, train, "train", key, column),
        "rest": "SELECT * EXCLUDE (train) FROM train_marked WHERE NOT train",
        **cut("val", "rest", val / (val + test), "val", key, column),
        "split_table": """
SELECT * EXCLUDE (train), 'train' AS split FROM train_marked WHERE train
UNION ALL
SELECT * EXCLUDE (val), CASE WHEN val THEN 'val' ELSE 'test' END AS split FROM val_marked""",
    }


def sample(source: str, n: int, salt: str, key: str, by: str = "''") -> str:
    return f"""
SELECT * FROM {source}
QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order_key(salt, key)}) <= {n}"""


def shots(source: str, n: int) -> dict:
    return {
        "shots": f"""
SELECT row_number() OVER (ORDER BY {order_key('shots', 'id')}) AS number,
       substring(abstract, 1, 1200) AS abstract, title
FROM ({sample(source, n, 'shots', 'id')})""",
        "block": f"""
SELECT 'Examples:' || chr(10) || string_agg(
  'Example ' || number || ' Abstract: ' || {collapse('abstract')} || chr(10) ||
  'Example ' || number || ' Title: ' || {collapse('title')}, chr(10) ORDER BY number) AS block
FROM shots""",
    }


CLEAN_PAPERS = {"papers": PAPERS, "cleaned": clean("papers")}
UNIQUE_PAPERS = {
    **CLEAN_PAPERS,
    "by_id": keep_first("cleaned", "id"),
    "firsts": keep_first("by_id", "title", "abstract"),
}


# --- metrics -------------------------------------------------------------------


def six(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


def row_metric_ctes(source: str, by: list[str]) -> dict:
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    metrics = {
        "empty_rate": "CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END",
        "length_compliance_rate": "CASE WHEN size BETWEEN 4 AND 15 THEN 1.0 ELSE 0.0 END",
        "avg_title_words": "size",
        "compression_ratio_mean": "size::DOUBLE / source_size",
        "exact_match_rate": "CASE WHEN lower(p) = lower(r) THEN 1.0 ELSE 0.0 END",
        "jaccard_title_reference_mean": "jaccard",
    }
    means = ", ".join(six(f"coalesce(avg(CAST({x} AS DOUBLE)), 0)", n) for n, x in metrics.items())
    jaccard = """CASE WHEN len(list_distinct(list_concat(pw, rw))) = 0 THEN 1.0
      ELSE len(list_intersect(list_distinct(pw), list_distinct(rw)))::DOUBLE
           / len(list_distinct(list_concat(pw, rw))) END"""
    return {
        "worded": f"""
SELECT *, {strip('prediction')} AS p, {strip('reference')} AS r,
  {words('prediction')} AS pw, {words('reference')} AS rw,
  greatest(len({words('abstract')}), 1) AS source_size FROM {source}""",
        "sized": f"SELECT *, len(pw) AS size, {jaccard} AS jaccard FROM worded",
        "row_means": f"SELECT {keys}{means} FROM sized {group}",
    }


def corpus_metric_ctes(source: str, by: list[str]) -> dict:
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""

    def ratio(table: str, gram: str) -> str:
        return f"""
SELECT {keys}coalesce(count(DISTINCT {gram})::DOUBLE / nullif(count({gram}), 0), 0) AS ratio
FROM {table} {group}"""

    on = " AND ".join(f"d.{k} = {{0}}.{k}" for k in by) or "true"
    ratios = {
        "d_words": f"SELECT {keys}{words('prediction')} AS t FROM {source}",
        "d_one": f"SELECT {keys}unnest(t) AS g FROM d_words",
        "d_two": f"""SELECT {keys}unnest(list_transform(range(1, len(t)),
            lambda i: t[i] || ' ' || t[i + 1])) AS g FROM d_words""",
        "d_ones": ratio("d_one", "g"),
        "d_twos": ratio("d_two", "g"),
        "d_whole": f"""SELECT {keys}CASE WHEN count(*) = 0 THEN 0.0
            ELSE 1 - count(DISTINCT {strip('prediction')})::DOUBLE / count(*) END AS ratio
            FROM {source} {group}""",
        "diversity": f"""
SELECT {''.join(f'd.{k}, ' for k in by)}{six('d.ratio', 'duplicate_rate')},
  {six('coalesce(o.ratio, 0)', 'distinct_1')}, {six('coalesce(t.ratio, 0)', 'distinct_2')}
FROM d_whole d LEFT JOIN d_ones o ON {on.format('o')} LEFT JOIN d_twos t ON {on.format('t')}""",
    }
    return ratios


def scorecard_ctes(source: str, by: list[str]) -> dict:
    on = " AND ".join(f"m.{k} = d.{k}" for k in by) or "true"
    drop = f" EXCLUDE ({', '.join(by)})" if by else ""
    return {
        **row_metric_ctes(source, by),
        **corpus_metric_ctes(source, by),
        "quality": f"""
SELECT m.*, d.*{drop}, CAST(-1 AS DOUBLE) AS semantic_cosine_mean,
  CAST(1 AS DOUBLE) AS semantic_failed
FROM row_means m JOIN diversity d ON {on}""",
    }


def gram_rows(table: str, tokens: str, keys: str, orders: str) -> str:
    return f"""
SELECT {keys}, n, array_to_string(t[i:i + n - 1], ' ') AS gram, count(*) AS seen
FROM (SELECT {keys}, n, t, unnest(range(1, len(t) - n + 2)) AS i
      FROM (SELECT {keys}, {tokens} AS t, unnest({orders}) AS n FROM {table}))
GROUP BY {keys}, n, gram"""


def match_ctes(table: str, keys: str, orders: str) -> dict:
    """Clipped matches per row and order; ``table`` has token lists pt and rt."""
    on = " AND ".join(f"p.{k} = r.{k}" for k in keys.split(", "))
    return {
        "p_grams": gram_rows(table, "pt", keys, orders),
        "r_grams": gram_rows(table, "rt", keys, orders),
        "matches": f"""
SELECT {', '.join('p.' + k for k in keys.split(', '))}, p.n,
  CAST(sum(least(p.seen, r.seen)) AS BIGINT) AS m
FROM p_grams p JOIN r_grams r ON {on} AND p.n = r.n AND p.gram = r.gram GROUP BY ALL""",
    }


def f_measure(m: str, p: str, r: str) -> str:
    precision, recall = f"(({m})::DOUBLE / greatest({p}, 1))", f"(({m})::DOUBLE / greatest({r}, 1))"
    return (f"CASE WHEN {m} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) "
            f"ELSE 0 END")


def lcs_ctes(table: str, keys: str) -> dict:
    """Common-subsequence length per row by the usual recurrence.

    One recursion step handles one reference word for all rows at once: cell j
    becomes the running maximum of the old cells and the diagonal plus a match.
    """
    cells = """list_transform(range(1, len(pt) + 1), lambda j: greatest(cells[j],
        (CASE WHEN j > 1 THEN cells[j - 1] ELSE 0 END) + (CASE WHEN pt[j] = rt[i] THEN 1 ELSE 0 END)))"""
    running = "list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))"
    return {
        "lcs_steps": f"""
SELECT {keys}, pt, rt, 1 AS i, list_transform(pt, lambda w: 0) AS cells FROM {table}
UNION ALL /*step*/
SELECT {keys}, pt, rt, i + 1, {running}
FROM (SELECT {keys}, pt, rt, i, {cells} AS c FROM lcs_steps WHERE i <= len(rt) AND len(pt) > 0)""",
        "lcs": f"""
SELECT {keys}, coalesce(list_max(cells), 0) AS lcs FROM lcs_steps
WHERE i = len(rt) + 1 OR len(pt) = 0""",
    }


def rouge_ctes(table: str, keys: str, lcs: bool = True) -> dict:
    """Row-level ROUGE from token lists pt and rt."""
    on = [" AND ".join(f"t.{k} = {a}.{k}" for k in keys.split(", ")) for a in ("a", "b", "l")]
    size = {n: (f"greatest(len(pt) - {n - 1}, 0)", f"greatest(len(rt) - {n - 1}, 0)") for n in (1, 2)}
    last = f", {f_measure('coalesce(l.lcs, 0)', *size[1])} AS \"rougeL\"" if lcs else ""
    join = f"LEFT JOIN lcs l ON {on[2]}" if lcs else ""
    return {
        **match_ctes(table, keys, "[1, 2]"),
        **(lcs_ctes(table, keys) if lcs else {}),
        "rouge": f"""
SELECT t.*, {f_measure('coalesce(a.m, 0)', *size[1])} AS rouge1,
  {f_measure('coalesce(b.m, 0)', *size[2])} AS rouge2{last}
FROM {table} t LEFT JOIN matches a ON {on[0]} AND a.n = 1
LEFT JOIN matches b ON {on[1]} AND b.n = 2 {join}""",
    }


def plain_tokens(source: str) -> str:
    return f"""
SELECT * EXCLUDE (prediction, reference), {split_words(rouge_text('prediction'))} AS pt,
  {split_words(rouge_text('reference'))} AS rt FROM {source}"""


def rouge_means(by: list[str]) -> str:
    means = ", ".join(f"round(avg({name}), 6) AS {name}" for name in ("rouge1", "rouge2", '"rougeL"'))
    return f"SELECT {', '.join(by)}, {means} FROM rouge GROUP BY {', '.join(by)}"


def bleu_ctes(source: str, row: str, by: list[str]) -> dict:
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    sums = ", ".join(
        f"coalesce(sum(m{n}), 0)::DOUBLE AS m{n}, sum(greatest(len(pt) - {n - 1}, 0))::DOUBLE AS t{n}"
        for n in (1, 2, 3, 4)
    )
    per_row = ", ".join(f"max(m.m) FILTER (m.n = {n}) AS m{n}" for n in (1, 2, 3, 4))
    zeros, logs = "0", []
    for n in (1, 2, 3, 4):
        zeros += f" + CASE WHEN m{n} = 0 THEN 1 ELSE 0 END"
        logs.append(
            f"ln(CASE WHEN m{n} = 0 THEN 100 / (pow(2, {zeros}) * t{n}) ELSE 100 * m{n} / t{n} END)"
        )
    score = f"""CASE WHEN m1 + m2 + m3 + m4 > 0 AND least(t1, t2, t3, t4) > 0
      THEN (CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END) * exp(({' + '.join(logs)}) / 4)
      ELSE 0 END"""
    on = " AND ".join(f"t.{k} = s.{k}" for k in row.split(", "))
    return {
        "bleu_tokens": f"""
SELECT *, {split_words(bleu_text('prediction'))} AS pt, {split_words(bleu_text('reference'))} AS rt
FROM {source}""",
        **match_ctes("bleu_tokens", row, "[1, 2, 3, 4]"),
        "row_matches": f"SELECT {row}, {per_row} FROM matches m GROUP BY {row}",
        "bleu_sums": f"""
SELECT {keys}{sums}, sum(len(pt))::DOUBLE AS c, sum(len(rt))::DOUBLE AS r
FROM bleu_tokens t LEFT JOIN row_matches s ON {on} {group.replace('GROUP BY ', 'GROUP BY t.').replace(', ', ', t.')}"""
        .replace(f"SELECT {keys}", "SELECT " + "".join(f"t.{k}, " for k in by)),
        "bleu": f"SELECT {keys}round({score}, 6) AS bleu FROM bleu_sums",
    }


# --- stems by regex ------------------------------------------------------------


def shape(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    out = f"regexp_replace({out}, '^y', 'c')"
    for _ in range(4):
        out = f"replace(replace({out}, 'vy', 'vc'), 'cy', 'cv')"
    return out


def measure(x: str) -> str:
    return f"len(regexp_extract_all({shape(x)}, 'v+c'))"


def ends_short(x: str) -> str:
    s = shape(x)
    return f"({s} = 'vc' OR (ends_with({s}, 'cvc') AND right({x}, 1) NOT IN ('w', 'x', 'y')))"


def chop(n: int, x: str = "w") -> str:
    return f"left({x}, len({x}) - {n})"


def stem_ctes(vocabulary: str) -> dict:
    """Stem of every word in the column ``word`` of ``vocabulary``."""
    irregular = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stemming.IRREGULAR.items() if len(w) > 3)
    past = f"""CASE
      WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {chop(1)} ELSE {chop(2)} END
      WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(chop(3))} > 0 THEN {chop(1)} ELSE w END
      WHEN ends_with(w, 'ed') AND contains({shape(chop(2))}, 'v') THEN '+' || {chop(2)}
      WHEN ends_with(w, 'ing') AND contains({shape(chop(3))}, 'v') THEN '+' || {chop(3)}
      ELSE w END"""
    repair = f"""CASE WHEN NOT starts_with(w, '+') THEN w
      WHEN regexp_matches(w, '(at|bl|iz)$') THEN substring(w, 2) || 'e'
      WHEN len(w) > 2 AND right(w, 1) = left(right(w, 2), 1) AND ends_with({shape('substring(w, 2)')}, 'c')
        THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN substring(w, 2)
             ELSE substring(w, 2, len(w) - 2) END
      WHEN {measure('substring(w, 2)')} = 1 AND {ends_short('substring(w, 2)')}
        THEN substring(w, 2) || 'e'
      ELSE substring(w, 2) END"""
    steps = [
        f"""CASE WHEN len(w) = 4 AND ends_with(w, 'ies') THEN {chop(1)}
          WHEN ends_with(w, 'sses') THEN {chop(2)} WHEN ends_with(w, 'ies') THEN {chop(2)}
          WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {chop(1)} ELSE w END""",
        past,
        repair,
        f"""CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND ends_with({shape(chop(1))}, 'c')
          THEN {chop(1)} || 'i' ELSE w END""",
        f"CASE WHEN ends_with(w, 'alli') AND {measure(chop(4))} > 0 THEN {chop(2)} ELSE w END",
        guarded(stemming.DOUBLE_SUFFIXES, 0),
        guarded(stemming.ENDINGS, 0),
        guarded([(s, "") for s in stemming.RESIDUES], 1),
        f"""CASE WHEN ends_with(w, 'e') AND ({measure(chop(1))} > 1 OR
          ({measure(chop(1))} = 1 AND NOT {ends_short(chop(1))})) THEN {chop(1)} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {measure(chop(1))} > 1 THEN {chop(1)} ELSE w END",
    ]
    ctes = {"stem0": f"SELECT word, word AS w FROM {vocabulary}"}
    for i, step in enumerate(steps, 1):
        ctes[f"stem{i}"] = f"SELECT word, {step} AS w FROM stem{i - 1}"
    ctes["stems"] = f"""
SELECT word, CASE WHEN len(word) < 4 THEN word
  ELSE CASE word {irregular} ELSE w END END AS stem FROM stem{len(steps)}"""
    return ctes


def guarded(rules: list[tuple[str, str]], above: int) -> str:
    """CASE over the first fitting suffix, whose stem must measure more than ``above``."""
    arms = []
    for suffix, replacement in rules:
        stem = chop(len(suffix))
        tested = chop(len(suffix) - 1) if suffix == "logi" else stem
        extra = f" AND right({stem}, 1) IN ('s', 't')" if suffix == "ion" else ""
        arms.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure(tested)} > {above}{extra} "
                    f"THEN {stem} || '{replacement}' ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


def stemmed_ctes(source: str, keys: str) -> dict:
    """Token lists pt and rt of stems, kept in order."""

    def stemmed(side: str) -> str:
        return f"""
SELECT {keys}, list(s.stem ORDER BY i) AS t
FROM (SELECT {keys}, unnest({side}) AS word, unnest(range(1, len({side}) + 1)) AS i FROM plain) u
JOIN stems s ON u.word = s.word GROUP BY {keys}"""

    on = [" AND ".join(f"b.{k} = {a}.{k}" for k in keys.split(", ")) for a in ("p", "r")]
    return {
        "plain": plain_tokens(source),
        "vocabulary": "SELECT DISTINCT unnest(list_concat(pt, rt)) AS word FROM plain",
        **stem_ctes("vocabulary"),
        "p_stems": stemmed("pt"),
        "r_stems": stemmed("rt"),
        "tokens": f"""
SELECT b.* EXCLUDE (pt, rt), coalesce(p.t, []) AS pt, coalesce(r.t, []) AS rt
FROM plain b LEFT JOIN p_stems p ON {on[0]} LEFT JOIN r_stems r ON {on[1]}""",
    }


# --- one entry per query -------------------------------------------------------

BASE = {"papers": PAPERS}
WORK = {"works": WORKS}

ORACLES["works_read_json"] = query(
    **WORK,
    result=f"""
SELECT id, title, display_name, publication_year,
  CAST(publication_date AS VARCHAR) AS publication_date,
  CASE WHEN has_index THEN len(list_distinct(string_split({collapse('text')}, ' '))) END
    AS index_words,
  array_to_string(list_transform(topic_keys, lambda t: '{SITE}/topics/' || t), '|') AS topic_urls
FROM works""",
)
ORACLES["works_filter"] = query(
    **WORK,
    result="""
SELECT seq, id, CAST(publication_date AS VARCHAR) AS publication_date FROM works
WHERE publication_date BETWEEN DATE '2019-03-01' AND DATE '2024-06-30'
  AND list_has_any(topic_keys, ['src1', 'src2', 'fr']) AND list_has_any(concept_keys, ['en', 'fr'])""",
)
ORACLES["works_cap_deduplicate"] = query(
    **WORK,
    capped="SELECT id, display_name, seq FROM works ORDER BY seq LIMIT 600",
    kept="SELECT * FROM capped WHERE id <> ''",
    result=keep_first("kept", "id"),
)
ORACLES["works_keep_first"] = query(
    **WORK,
    kept="SELECT id, display_name, seq FROM works WHERE id <> ''",
    result=keep_first("kept", "id"),
)
ORACLES["works_with_id"] = query(**WORK, result="SELECT id, seq FROM works WHERE id <> ''")
ORACLES["papers_read_csv"] = query(
    **BASE,
    result=f"""
SELECT id, nullif(title, '') AS title, abstract,
  CAST(publication_year AS VARCHAR) AS publication_year, topics, primary_topic FROM papers""",
)
ORACLES["papers_read_csv_in_order"] = query(
    **BASE,
    firsts=keep_first("papers", "title"),
    result="SELECT id, nullif(title, '') AS title FROM firsts",
)
for name, columns in {
    "splits_read_prepared": "split, primary_topic, count(*) AS rows",
    "splits_read_csv": "id, title, split",
}.items():
    ORACLES[name] = query(
        **CLEAN_PAPERS,
        **split("cleaned", "id", "primary_topic"),
        result=f"SELECT {columns} FROM split_table" + (" GROUP BY ALL" if "count" in columns else ""),
    )

ORACLES["canonical_standard"] = query(
    **BASE, result=f"SELECT {', '.join(CANONICAL)} FROM papers"
)
ORACLES["canonical_without_id"] = query(
    **BASE, result="SELECT '' AS id, title, abstract, publication_year, primary_topic FROM papers"
)
ORACLES["canonical_legacy"] = ORACLES["canonical_standard"]
ORACLES["canonical_capitalised"] = query(
    **BASE, result="SELECT '' AS id, title, abstract, primary_topic FROM papers"
)
ORACLES["canonical_detected"] = query(
    **BASE,
    result="""
SELECT layout, CASE WHEN layout = 'capitalised' THEN '' ELSE id END AS id, title, primary_topic
FROM papers, (VALUES ('standard'), ('legacy_works'), ('capitalised')) AS l(layout)""",
)
ORACLES["canonical_keep_columns"] = ORACLES["canonical_standard"]
ORACLES["works_normalise"] = query(**WORK, result=NORMAL)
ORACLES["works_drop_empty_abstract"] = query(
    **WORK, normal=NORMAL, result="SELECT seq, id, abstract FROM normal WHERE abstract <> ''"
)
ORACLES["human_eval_sheet"] = query(
    **SCORED_PARTS,
    lead=LEAD,
    result="""
SELECT id, '' AS abstract, title AS reference_title, predicted_title, split,
  'lead' AS model, 'zero_shot' AS mode FROM lead""",
)
ORACLES["generated_titles"] = query(
    **SCORED_PARTS, lead=LEAD, result="SELECT split, id, predicted_title FROM lead"
)
ORACLES["attach_predictions"] = query(
    **BASE,
    **SCORED_PARTS,
    lead=LEAD,
    result="""
SELECT 'lead-' || p.id AS id, p.title, l.predicted_title
FROM papers p LEFT JOIN lead l ON 'lead-' || p.id = l.id""",
)

ORACLES["papers_clean"] = query(**BASE, result=clean("papers"))
ORACLES["papers_clean_strict"] = query(
    **BASE,
    strict=clean("papers", 60, 1500),
    result="SELECT id, length(title) AS title_chars, length(abstract) AS abstract_chars FROM strict",
)
SHARED = """
SELECT * REPLACE (CASE WHEN {blank} THEN ' ' ELSE md5(title) END AS id) FROM papers"""
ORACLES["deduplicate_by_id"] = query(
    **BASE,
    shared=SHARED.format(blank="false"),
    cleaned=clean("shared"),
    by_id=keep_first("cleaned", "id"),
    firsts=keep_first("by_id", "title", "abstract"),
    result="SELECT id, title, abstract, seq FROM firsts",
)
ORACLES["deduplicate_gate_closed"] = query(
    **BASE,
    shared=SHARED.format(blank="seq % 10 = 3"),
    cleaned=clean("shared"),
    firsts=keep_first("cleaned", "title", "abstract"),
    result="SELECT id, title, abstract, seq FROM firsts",
)
ORACLES["deduplicate_by_content"] = query(
    **CLEAN_PAPERS, result=keep_first("cleaned", "title", "abstract")
)
ORACLES["prepare_papers"] = query(
    **UNIQUE_PAPERS,
    **split("firsts", "id", "primary_topic"),
    result="SELECT * EXCLUDE (seq), id AS row_key FROM split_table",
)
ORACLES["prepare_split_counts"] = query(
    **UNIQUE_PAPERS,
    **split("firsts", "id", "primary_topic"),
    result="SELECT split, primary_topic, count(*) AS rows FROM split_table GROUP BY ALL",
)
def named(parts: dict, prefix: str, names: set[str]) -> dict:
    """The same CTEs under other names, so that a query can hold two of them."""
    renamed = {}
    for name, sql in parts.items():
        for old in names:
            sql = re.sub(rf"\b{old}\b", prefix + old, sql)
        renamed[prefix + name] = sql
    return renamed


def two_tables() -> dict:
    out = {}
    for table, blank in (("full", "false"), ("blank", "seq % 10 = 3")):
        topic = "CASE WHEN seq % 50 = 0 THEN CAST(seq AS VARCHAR) ELSE primary_topic END" if table == "blank" else "primary_topic"
        chain = {
            "shared": f"SELECT * REPLACE (CASE WHEN {blank} THEN ' ' ELSE md5(title) END AS id, {topic} AS primary_topic) FROM papers",
            "cleaned": clean("shared"),
            "by_id": keep_first("cleaned", "id") if table == "full" else "SELECT * FROM cleaned",
            "firsts": keep_first("by_id", "title", "abstract"),
            "keyed": f"""SELECT *, '={table}' || chr(31) || {"id" if table == "full" else "sha256(title || chr(31) || abstract)"} AS row_key
FROM firsts""",
            **split("keyed", "row_key", "primary_topic"),
        }
        out |= named(chain, f"{table}_", set(chain))
    return out


ORACLES["prepare_two_tables"] = query(
    **BASE,
    **two_tables(),
    result="""
SELECT 'full' AS collection, sha256(row_key) AS key_sha256, title, primary_topic, split FROM full_split_table
UNION ALL SELECT 'blank', sha256(row_key), title, primary_topic, split FROM blank_split_table""",
)
ORACLES["splits_prepare_now"] = query(
    **UNIQUE_PAPERS, **split("firsts", "id", "topics"), result="SELECT id, split FROM split_table"
)
ORACLES["collect_then_prepare"] = query(
    all_works=WORKS,
    works="""
SELECT * FROM (SELECT * FROM all_works WHERE publication_date >= DATE '2019-03-01'
               AND list_has_any(concept_keys, ['en', 'fr', 'de']) AND id <> '')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1""",
    normal=NORMAL,
    papers="SELECT * FROM normal WHERE abstract <> ''",
    cleaned=clean("papers"),
    by_id=keep_first("cleaned", "id"),
    firsts=keep_first("by_id", "title", "abstract"),
    **split("firsts", "id", "primary_topic"),
    result="SELECT id, title, primary_topic, split FROM split_table",
)
ORACLES["prepare_blank_ids"] = query(
    **CLEAN_PAPERS,
    firsts=keep_first("cleaned", "title", "abstract"),
    keyed="SELECT *, sha256(title || chr(31) || abstract) AS row_key FROM firsts",
    **split("keyed", "row_key", "primary_topic"),
    result="SELECT row_key, title, split FROM split_table",
)

ORACLES["stratum_counts"] = query(
    **BASE,
    result="""
SELECT coalesce(CASE WHEN seq % 6 > 0 THEN primary_topic END, '__NA__') AS stratum,
  count(*) AS size FROM papers GROUP BY 1""",
)
ORACLES["stratify_gate"] = query(
    **BASE,
    strata="""
SELECT 'primary_topic' AS stratum_column, primary_topic AS s, count(*) AS n FROM papers GROUP BY ALL
UNION ALL SELECT 'topics', topics, count(*) FROM papers GROUP BY ALL
UNION ALL SELECT 'size', CAST(length(title) AS VARCHAR), count(*) FROM papers GROUP BY ALL""",
    result="""
SELECT stratum_column, count(*) AS strata, CAST(sum(n) AS BIGINT) AS total,
  count(*) >= 2 AND min(n) >= 2 AS stratify FROM strata GROUP BY 1""",
)
ORACLES["stratum_quotas"] = query(
    strata="SELECT CAST(doc_id % 37 AS VARCHAR) AS stratum, count(*) AS size FROM documents GROUP BY 1",
    quotas=quotas("strata", "(SELECT floor(0.83::DOUBLE * count(*)) FROM documents)"),
    result="SELECT stratum, CAST(size AS BIGINT) AS size, quota FROM quotas",
)
ORACLES["split_train_rest"] = query(
    **BASE,
    slim="SELECT id, primary_topic FROM papers",
    **cut("train", "slim", 0.8, "train", "id", "primary_topic"),
    result="SELECT * FROM train_marked",
)
ORACLES["split_stratified"] = query(
    **BASE,
    slim="SELECT id, topics FROM papers",
    **split("slim", "id", "topics", 0.7, 0.1, 0.2),
    result="SELECT * FROM split_table",
)
ORACLES["split_unstratified"] = query(
    **BASE,
    slim="SELECT id FROM papers",
    **split("slim", "id", None),
    result="SELECT * FROM split_table",
)
ORACLES["split_gate_closed"] = query(
    **BASE,
    slim="SELECT id, length(title) AS title_size FROM papers",
    **split("slim", "id", "title_size"),
    result="SELECT id, split FROM split_table",
)
ORACLES["split_sizes"] = query(
    **BASE,
    **split("papers", "id", "primary_topic"),
    result="""
SELECT split, count(*) AS rows FROM split_table GROUP BY 1
UNION ALL SELECT 'full', count(*) FROM split_table""",
)
TRAIN = {"train": "SELECT * FROM papers"}
ORACLES["few_shot_examples"] = query(
    **BASE, **TRAIN, **shots("train", 4), result="SELECT * FROM shots"
)
ORACLES["evaluation_sample"] = query(
    **SCORED_PARTS,
    named="SELECT run || '-' || id AS id, split FROM scored",
    result=sample("named", 400, "eval", "id", "split"),
)
ORACLES["evaluation_sample_by_cut"] = query(
    lines="SELECT l_orderkey, l_linenumber, l_returnflag AS split FROM lineitem",
    result=sample("lines", 12_000, "eval", "(l_orderkey || '-' || l_linenumber)", "split"),
)
HUMAN = """
SELECT id, title AS reference_title, predicted_title, split, 'lead' AS model, 'zero_shot' AS mode
FROM lead"""
ORACLES["human_eval_sample"] = query(
    **SCORED_PARTS, lead=LEAD, sheet=HUMAN, result=sample("sheet", 100, "human", "id", "split")
)

ORACLES["text_collapse"] = f"SELECT doc_id, {collapse('text')} AS collapsed FROM documents"
PADDED = "(chr(9) || ' ' || chr(160) || text || ' ' || chr(10))"
ORACLES["text_strip"] = f"SELECT doc_id, {strip(PADDED)} AS stripped FROM documents"
ORACLES["abstract_rebuild"] = f"SELECT doc_id, {collapse('text')} AS abstract FROM documents"
ORACLES["url_last_segment"] = query(
    urls="""
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 3 = 0 THEN url || '//'
  ELSE url END AS u FROM pages""",
    result=f"SELECT page_id, {short_id('u')} AS segment FROM urls",
)
ORACLES["topic_fields"] = query(
    **WORK,
    result=f"""
SELECT seq, {joined("list_filter(topic_labels, lambda t: t IS NOT NULL)")} AS topic_names,
  {joined('topic_keys')} AS topic_ids, {joined('concept_keys')} AS concept_names,
  topic_labels[1] AS primary_topic FROM works""",
)
ORACLES["topics_as_json"] = """
SELECT doc_id, '["' || source || '","' || lang || '"]' AS topics FROM documents"""
ORACLES["text_slug"] = f"""
SELECT 'd' || doc_id AS key, {slug(first_line())} AS slug FROM documents
UNION ALL SELECT 'p' || page_id, {slug('url')} FROM pages"""
ORACLES["text_words"] = f"""
SELECT doc_id, len({words('text')}) AS word_count,
  md5(array_to_string({words('text')}, ' ')) AS words_md5 FROM documents"""
ORACLES["text_ngrams"] = query(
    tokens=f"SELECT doc_id, {words('text')} AS pt FROM documents",
    grams=gram_rows("tokens", "pt", "doc_id", "[1, 2, 3, 4]"),
    result="""
SELECT n, gram, CAST(sum(seen) AS BIGINT) AS seen FROM grams GROUP BY ALL""",
)
ORACLES["title_jaccard"] = query(
    **SCORED_PARTS,
    **row_metric_ctes("scored", ["run"]),
    result=f"SELECT id, run, {six('jaccard', 'jaccard')} FROM sized",
)
ORACLES["title_postprocess"] = query(
    raws="""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '"' ELSE ' ' END ||
  CASE WHEN doc_id % 3 = 0 THEN 'Title : ' WHEN doc_id % 5 = 0 THEN 'TITLE:''' ELSE '`' END ||
  text || CASE WHEN doc_id % 4 = 0 THEN '"''' ELSE chr(10) END AS raw FROM documents""",
    result=f"""
SELECT doc_id, {clean_title('raw', 15)} AS title, md5({clean_title('raw', 0)}) AS uncut_md5
FROM raws""",
)
ORACLES["first_words"] = f"SELECT doc_id, {first_words(collapse('text'), 7)} AS lead FROM documents"
ORACLES["few_shot_prefix"] = """
SELECT doc_id, md5(substring(text, 1, 1200)) AS prefix_md5 FROM documents"""
ORACLES["vocabulary_stems"] = query(
    vocabulary=f"SELECT DISTINCT unnest({split_words(rouge_text('text'))}) AS word FROM documents",
    **stem_ctes("vocabulary"),
    result="SELECT word, stem FROM stems",
)
ORACLES["vector_normalise"] = """
SELECT vec_id, unnest(range(0, len(v))) AS place,
  unnest(list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)))
    AS value
FROM (SELECT vec_id, CAST(list_transform(embedding, lambda x: x * CAST(vec_id + 1 AS FLOAT))
        AS DOUBLE[]) AS v FROM embeddings)"""
ORACLES["vector_mean_pool"] = """
SELECT vec_id, j AS place, round(coalesce(sum(v * mask), 0) / greatest(sum(mask), 1e-9), 6) AS value
FROM (SELECT vec_id, i, j, CAST(embedding[i * 8 + j + 1] AS DOUBLE) AS v,
        CASE WHEN vec_id % 50 <> 0 AND (vec_id + i) % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END AS mask
      FROM embeddings, range(0, 8) AS a(i), range(0, 8) AS b(j))
GROUP BY vec_id, j"""
ORACLES["mask_label_ids"] = f"""
SELECT doc_id, md5(array_to_string(list_transform({words('text')},
  lambda w: CASE WHEN length(w) < 3 THEN '0' ELSE CAST(length(w) AS VARCHAR) END), '|'))
  AS label_ids_md5 FROM documents"""

ORACLES["prompt_seq2seq"] = f"""
SELECT doc_id, {lit(prompts.INSTRUCTION)} || chr(10) || chr(10) || text AS prompt FROM documents"""
HEAD = " || chr(10) || ".join(lit(x) for x in [prompts.ROLE, prompts.INSTRUCTION, *prompts.RULES])


def prompt(abstract: str, block: str = "''") -> str:
    return f"""{HEAD} || chr(10) || {block} || 'Abstract: ' || {collapse(abstract)}
  || chr(10) || 'Title:'"""


ORACLES["prompt_zero_shot"] = (
    f"SELECT doc_id, {prompt('text')} AS prompt, 'zero_shot' AS mode FROM documents"
)
ORACLES["prompt_few_shot"] = query(
    **BASE,
    **TRAIN,
    **shots("train", 4),
    result=f"""
SELECT id, {prompt('abstract', '(SELECT block FROM block) || chr(10)')} AS prompt,
  'few_shot' AS mode FROM papers""",
)
ANSWER = "'Title: ' || array_to_string(string_split(abstract, ' ')[1:12], ' ')"
ORACLES["predict_titles"] = query(
    **CLEAN_PAPERS,
    result=f"""
SELECT id, {clean_title(ANSWER, 15)} AS predicted_title, md5({prompt('abstract')}) AS prompt_md5
FROM cleaned""",
)
ORACLES["predict_fixed_batches"] = f"""
SELECT doc_id, {collapse("'Title: ' || array_to_string(string_split(text, ' ')[1:5], ' ')")}
  AS predicted_title FROM documents"""
ORACLES["batched_map_columns"] = query(
    **CLEAN_PAPERS,
    result="""
SELECT length(abstract) AS input_chars, array_to_string(list_transform(string_split(title, ' '),
  lambda w: CAST(length(w) AS VARCHAR)), '|') AS labels FROM cleaned""",
)

RUN = ["run", "split"]
ORACLES["quality_scorecard"] = query(
    **SCORED_PARTS, **scorecard_ctes("scored", RUN), result="SELECT * FROM quality"
)
ORACLES["quality_scorecard_overall"] = query(
    **SCORED_PARTS, **scorecard_ctes("scored", []), result="SELECT * FROM quality"
)
ORACLES["quality_scorecard_empty"] = query(
    **SCORED_PARTS,
    none="SELECT * FROM scored WHERE run = 'missing'",
    **scorecard_ctes("none", []),
    result="SELECT * FROM quality",
)
ORACLES["quality_row_means"] = query(
    **SCORED_PARTS, **row_metric_ctes("scored", RUN), result="SELECT * FROM row_means"
)
ORACLES["quality_duplicates_and_diversity"] = query(
    **SCORED_PARTS, **corpus_metric_ctes("scored", ["run"]), result="SELECT * FROM diversity"
)
ORACLES["quality_dialogues"] = query(
    pairs=DIALOGUES, **scorecard_ctes("pairs", []), result="SELECT * FROM quality"
)
ORACLES["semantic_cosine"] = query(
    pairs=PAIRS,
    result=f"""
SELECT label, round(avg({cosine('p', 'r')}), 6) AS semantic_cosine_mean,
  CAST(0 AS DOUBLE) AS semantic_failed FROM pairs GROUP BY label""",
)
ORACLES["semantic_missing_vectors"] = """
SELECT label, CASE WHEN label = 1 THEN -1.0::DOUBLE ELSE 1.0 END AS semantic_cosine_mean,
  CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS semantic_failed
FROM embeddings GROUP BY label"""

PLAIN = {**SCORED_PARTS, "tokens": plain_tokens("scored")}
ORACLES["rouge_rows_plain"] = query(
    **PLAIN,
    **rouge_ctes("tokens", "id, run"),
    result=f"""
SELECT id, run, {six('rouge1', 'rouge1')}, {six('rouge2', 'rouge2')}, {six('"rougeL"', '"rougeL"')}
FROM rouge""",
)
STEMMED = {**SCORED_PARTS, **stemmed_ctes("scored", "id, run")}
ORACLES["rouge_rows_stemmed"] = query(
    **STEMMED,
    **rouge_ctes("tokens", "id, run"),
    result=f"""
SELECT id, run, {six('rouge1', 'rouge1')}, {six('rouge2', 'rouge2')}, {six('"rougeL"', '"rougeL"')}
FROM rouge""",
)
ORACLES["rouge_by_run"] = query(
    **STEMMED, **rouge_ctes("tokens", "id, run"), result=rouge_means(RUN)
)
ORACLES["rouge_dialogues"] = query(
    pairs=DIALOGUES,
    tokens=plain_tokens("pairs"),
    **rouge_ctes("tokens", "conv_id, turn"),
    result=f"SELECT conv_id, turn, {six('rouge1', 'rouge1')}, {six('rouge2', 'rouge2')}, {six('rougeL', 'rougeL')} FROM rouge",
)
MASSES = ["exp(-1)" + "".join(f" / {i}" for i in range(2, k + 1)) for k in range(16)]
WEIGHT = " + ".join(
    f"CASE WHEN u >= {' + '.join(MASSES[:k])} THEN 1 ELSE 0 END" for k in range(1, 17)
)
ORACLES["rouge_bootstrap"] = query(
    **PLAIN,
    **rouge_ctes("tokens", "id, run", lcs=False),
    drawn=f"""
SELECT run, id, rouge1, b,
  ('0x' || substring(md5('{SEED}:' || b || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
FROM rouge, range(1, 41) AS r(b)""",
    means=f"""
SELECT run, b, sum(({WEIGHT}) * rouge1) / sum({WEIGHT}) AS mean FROM drawn GROUP BY run, b""",
    result="""
SELECT run, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS median,
  round(quantile_cont(mean, 0.975), 6) AS high FROM means GROUP BY run""",
)
ORACLES["bleu_by_run"] = query(
    **SCORED_PARTS, **bleu_ctes("scored", "id, run", RUN), result="SELECT * FROM bleu"
)
ORACLES["bleu_dialogues"] = query(
    pairs=DIALOGUES, **bleu_ctes("pairs", "conv_id, turn", []), result="SELECT * FROM bleu"
)
ORACLES["bleu_no_match"] = query(
    **SCORED_PARTS,
    turned="""
SELECT * REPLACE (reverse(prediction) AS prediction), doc_id % 40 AS "group" FROM scored""",
    **bleu_ctes("turned", "id, run", ["run", '"group"']),
    result="SELECT * FROM bleu",
)
SIMILAR = """list_transform(range(0, 8), lambda i: list_max(list_transform(range(0, 8), lambda j: {})))"""
MATCHED = f"""
SELECT label, vec_id, list_avg({SIMILAR.format(cosine('p[i*8+1:i*8+8]', 'r[j*8+1:j*8+8]'))}) AS precision,
  list_avg({SIMILAR.format(cosine('r[i*8+1:i*8+8]', 'p[j*8+1:j*8+8]'))}) AS recall
FROM pairs"""
ORACLES["token_matching"] = query(
    pairs=PAIRS,
    matched=MATCHED,
    result="""
SELECT label, round(avg(precision), 6) AS bertscore_precision,
  round(avg(recall), 6) AS bertscore_recall,
  round(avg(2 * precision * recall / (precision + recall)), 6) AS bertscore_f1,
  CAST(0 AS DOUBLE) AS bertscore_failed FROM matched GROUP BY label""",
)
ORACLES["token_matching_missing"] = query(
    **SCORED_PARTS,
    **bleu_ctes("scored", "id, run", ["run"]),
    result="""
SELECT run, bleu, CAST(-1 AS DOUBLE) AS bertscore_precision, CAST(-1 AS DOUBLE) AS bertscore_recall,
  CAST(-1 AS DOUBLE) AS bertscore_f1, CAST(1 AS DOUBLE) AS bertscore_failed FROM bleu""",
)


def bleu_and_rouge(source: str, by: list[str], stems: bool = False) -> dict:
    """CTEs ``text_scores``: BLEU and ROUGE side by side."""
    bleu = bleu_ctes(source, "id, run", by)
    renamed = {}
    for name, sql in bleu.items():
        for part in ("p_grams", "r_grams", "matches"):
            sql = sql.replace(f" {part} ", f" bleu_{part} ")
        renamed[f"bleu_{name}" if name in ("p_grams", "r_grams", "matches") else name] = sql
    tokens = stemmed_ctes(source, "id, run") if stems else {"tokens": plain_tokens(source)}
    on = " AND ".join(f"b.{k} = r.{k}" for k in by)
    return {
        **renamed,
        **tokens,
        **rouge_ctes("tokens", "id, run"),
        "rouge_means": rouge_means(by),
        "text_scores": f"SELECT r.*, b.bleu FROM rouge_means r JOIN bleu b ON {on}",
    }


ORACLES["checkpoint_metrics"] = query(
    **SCORED_PARTS,
    stepped="SELECT *, doc_id % 8 AS step FROM scored",
    **bleu_and_rouge("stepped", ["run", "step"]),
    result="SELECT * FROM text_scores",
)


def long_scores(keys: str) -> str:
    both = [
        f"SELECT {keys}, '{family}' AS family, metric, value FROM "
        f"(UNPIVOT {table} ON COLUMNS (* EXCLUDE ({keys})) INTO NAME metric VALUE value)"
        for family, table in (("text", "text_scores"), ("quality", "quality"))
    ]
    return " UNION ALL ".join(both)


ORACLES["scorecard_by_split"] = query(
    **SCORED_PARTS,
    one="SELECT * FROM scored",
    **bleu_and_rouge("one", ["split"]),
    **scorecard_ctes("one", ["split"]),
    result=long_scores("split"),
)
ORACLES["evaluate_end_to_end"] = query(
    **UNIQUE_PAPERS,
    **split("firsts", "id", "primary_topic"),
    scored=f"""
SELECT id, 'one' AS run, {clean_title(ANSWER, 15)} AS prediction, title AS reference, abstract, split,
  'few_shot' AS mode FROM split_table WHERE split <> 'train'""",
    **bleu_and_rouge("scored", ["split", "mode"], stems=True),
    **scorecard_ctes("scored", ["split", "mode"]),
    result=long_scores("split, mode"),
)

CHECKPOINTS = """
SELECT 'run' || user_id AS run, event_id AS step, value AS "eval_rougeL" FROM events"""
for name, order in {
    "best_checkpoint": ('"eval_rougeL" DESC, step', 1),
    "worst_checkpoint": ('"eval_rougeL", step', 1),
    "newest_checkpoints": ("step DESC", 2),
}.items():
    ORACLES[name] = query(
        checkpoints=CHECKPOINTS,
        result=f"""
SELECT * FROM checkpoints
QUALIFY row_number() OVER (PARTITION BY run ORDER BY {order[0]}) <= {order[1]}""",
    )
ORACLES["metric_long_table"] = query(
    **SCORED_PARTS,
    **row_metric_ctes("scored", RUN),
    result=" UNION ALL ".join(
        f"SELECT run, split, 'quality' AS family, '{m}' AS metric, {m} AS value FROM row_means"
        for m in ROW_METRICS
    ),
)
ORACLES["tradeoff_table"] = query(
    **PLAIN,
    **rouge_ctes("tokens", "id, run", lcs=False),
    pairs=PAIRS,
    matched=MATCHED,
    r="SELECT run AS model, split AS paradigm, avg(rouge1) AS r1 FROM rouge GROUP BY ALL",
    b="""
SELECT CASE WHEN vec_id % 2 = 0 THEN 'lead' ELSE 'tail' END AS model,
  CASE WHEN label % 2 = 0 THEN 'val' ELSE 'test' END AS paradigm,
  avg(2 * precision * recall / (precision + recall)) AS f1 FROM matched GROUP BY ALL""",
    result="""
SELECT coalesce(r.model, b.model) AS model, coalesce(r.paradigm, b.paradigm) AS paradigm,
  round(r1 * 100, 2) AS rouge1_percent, round(f1 * 100, 2) AS bertscore_f1_percent
FROM r FULL JOIN b ON r.model = b.model AND r.paradigm = b.paradigm""",
)
ORACLES["human_summary"] = query(
    scores="""
SELECT source AS model, lang = 'en' AS zero, 'quality' AS criterion, quality * 4 + 1.0 AS score
FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT source, lang = 'en', 'toxic', toxic * 4 + 1.0
FROM labels JOIN documents USING (doc_id)""",
    means="""
SELECT model, criterion, avg(score::DOUBLE) FILTER (zero) AS a, avg(score::DOUBLE) FILTER (NOT zero) AS b
FROM scores GROUP BY ALL""",
    result="""
SELECT model, criterion, round(a, 6) AS zero_shot, round(b, 6) AS few_shot,
  round(b - a, 6) AS change FROM means""",
)

ORACLES["dataset_sizes"] = query(
    **BASE,
    **split("papers", "id", "topics"),
    result="""
SELECT split, 'dataset_sizes' AS family, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT split FROM split_table UNION ALL SELECT 'full' FROM split_table) GROUP BY split""",
)

ORACLES["works_jsonl_round_trip"] = query(
    **WORK, normal=NORMAL, result="SELECT * EXCLUDE (seq) FROM normal"
)
ORACLES["works_csv_round_trip"] = query(
    **WORK,
    normal=NORMAL,
    result="""
SELECT nullif(id, '') AS id, nullif(title, '') AS title, abstract,
  CAST(publication_year AS VARCHAR) AS publication_year, topics, primary_topic
FROM normal WHERE abstract <> ''""",
)
COLLECTED = "SELECT * FROM works WHERE {where} AND id <> ''"
ORACLES["collect_papers"] = query(
    **WORK,
    chosen=COLLECTED.format(
        where="publication_date >= DATE '2019-03-01' "
        "AND list_has_any(topic_keys, ['src1', 'src2', 'src3', 'en'])"
    ),
    firsts=keep_first("chosen", "id"),
    result="""
SELECT topic_labels[1] AS primary_topic, count(*) AS papers FROM firsts WHERE has_index GROUP BY 1""",
)
ORACLES["collection_record"] = query(
    **WORK,
    chosen=COLLECTED.format(where="list_has_any(concept_keys, ['en', 'fr'])"),
    firsts=keep_first("chosen", "id"),
    result="""
SELECT '20240101T000000Z_natural_language_processing' AS run_name,
  'Natural  Language' || chr(9) || 'Processing!' AS query, 'concepts.id:en|fr' AS filter,
  count(*) AS records_saved, 'dropped' AS empty_abstract_policy FROM firsts WHERE has_index""",
)
ORACLES["split_files_round_trip"] = query(
    **CLEAN_PAPERS,
    **split("cleaned", "id", "primary_topic"),
    result="SELECT id, split FROM split_table",
)
ORACLES["predictions_round_trip"] = query(
    **SCORED_PARTS, lead=LEAD, result="SELECT id, title, predicted_title, split FROM lead"
)
ORACLES["evaluation_outputs_round_trip"] = query(
    **SCORED_PARTS,
    lead=LEAD,
    sampled=sample("lead", 100, "human", "id", "split"),
    result="""
SELECT output, split, count(*) AS rows, CAST(sum(CAST(split_part(id, '-', 2) AS BIGINT)) AS BIGINT) AS id_sum
FROM (SELECT 'generated_titles' AS output, id, split FROM lead
      UNION ALL SELECT 'human_eval', id, split FROM lead
      UNION ALL SELECT 'human_eval_sample', id, split FROM sampled) GROUP BY output, split""",
)
ORACLES["few_shot_round_trip"] = query(
    **BASE,
    **TRAIN,
    **shots("train", 6),
    result="SELECT number, title, md5(abstract) AS abstract_md5 FROM shots",
)
ORACLES["metrics_round_trip"] = query(
    **SCORED_PARTS,
    **corpus_metric_ctes("scored", ["run"]),
    result=" UNION ALL ".join(
        f"SELECT run, 'quality' AS family, '{m}' AS metric, {m} AS value FROM diversity"
        for m in ("duplicate_rate", "distinct_1", "distinct_2")
    ),
)
