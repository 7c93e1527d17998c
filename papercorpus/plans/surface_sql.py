"""SQL of the queries over SQL text, landed pages and co-located tables."""

from __future__ import annotations

from .inputs import PAGE
from .oracle import (
    ORACLES, SCORED_PARTS, WORK, bleu_text, clean_title, collapse, first_line, first_words, prompt, query, rouge_text, six, slug, strip, words,
)

ORACLES["sql_text_rules"] = f"""
SELECT doc_id, md5({collapse('text')}) AS collapsed_md5, md5({strip('text')}) AS stripped_md5, {slug(first_line())} AS slug,
  {clean_title('text', 15)} AS title, {first_words(collapse('text'), 7)} AS lead, len({words('text')}) AS words,
  md5({rouge_text('text')}) AS rouge_md5, md5({bleu_text('text')}) AS bleu_md5, {prompt('text')} AS prompt
FROM documents"""
ORACLES["sql_title_overlap"] = query(
    **SCORED_PARTS,
    sides=f"SELECT id, run, {words('prediction')} AS p, {words('reference')} AS r FROM scored",
    result=f"""
SELECT id, run, {six('''CASE WHEN len(p) + len(r) = 0 THEN 1.0
    ELSE len(list_intersect(p, r)) / len(list_distinct(list_concat(p, r))) END''', 'jaccard')},
  array_to_string(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), '|') AS pairs
FROM sides""",
)
ORACLES["sql_work_fields"] = ORACLES["topic_fields"]
ORACLES["sql_abstract_rebuild"] = ORACLES["abstract_rebuild"]
ORACLES["sql_word_pairs"] = f"""
SELECT w[i] AS word_1, w[i + 1] AS word_2, count(*) AS seen
FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {words('text')} AS w FROM documents)) GROUP BY ALL"""
ORACLES["sql_index_words"] = f"""
SELECT w[i + 1] AS word, count(*) AS places, CAST(sum(i) AS BIGINT) AS position_sum
FROM (SELECT w, unnest(range(len(w))) AS i FROM (SELECT string_split({collapse('text')}, ' ') AS w FROM documents))
WHERE w[i + 1] <> '' GROUP BY ALL"""
ORACLES["works_read_pages"] = query(
    **WORK,
    result=f"""
SELECT id, title, publication_year, publication_year AS asked_year,
  CAST(len(topic_keys) AS INTEGER) AS topics,
  CAST(row_number() OVER (PARTITION BY publication_year, seq // {PAGE} ORDER BY seq) - 1 AS INTEGER) AS item
FROM works QUALIFY publication_year >= 2010""",
)
ORACLES["splits_colocated"] = query(
    **SCORED_PARTS,
    result="""
SELECT s.split, s.run, count(*) AS rows, count(v.label) AS vectors, CAST(sum(v.label) AS BIGINT) AS labels,
  CAST(sum(length(s.prediction)) AS BIGINT) AS chars, CAST(count(*) FILTER (s.prediction = s.reference) AS BIGINT) AS same
FROM scored s LEFT JOIN embeddings v ON s.id = CAST(v.vec_id AS VARCHAR) GROUP BY s.split, s.run""",
)
