"""SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

OP11 = """
with vectors as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as vector
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), moved as (
    select vec_id, vector, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label from vectors
), scored as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
           cast(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) as bigint) as score
    from moved a join moved b on a.vec_id <> b.vec_id
    where a.vec_id % 100 = 0
), positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as integer) as rank,
       s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s using (anchor_id)
where not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""

OP13 = r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
           xor(list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''),
                   lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda crc, x: case when x >= 0 then xor(crc, x) when crc % 2 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end),
               4294967295) as h
    from documents
), sized as (
    select *, len(words) as n, h // 10 as g, (h // 10) % greatest(len(words), 1) as a from split
), planted as (
    select doc_id, n, case when h % 10 <> 0 or n = 0 then words else list_transform(range(n), lambda i:
               words[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as words
    from sized
), grams as (
    select doc_id, i, array_to_string(words[i + 1 : i + 6], ' ') as gram
    from (select doc_id, words, unnest(range(n - 5)) as i from planted where n > 11)
), alike as (
    select x.doc_id, x.i, y.i - x.i as period
    from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
), islands as (
    select *, i - row_number() over (partition by doc_id, period order by i) as island from alike
), stretches as (
    select doc_id, period, min(i) as start, count(*) + 5 + period as length from islands group by doc_id, period, island
), runs as (
    select doc_id, start, length, min(period) as period from stretches
    where length >= 2 * period and length >= 12 group by doc_id, start, length
), listed as (
    select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
           first({'start': start, 'length': length, 'period': period} order by length desc, start, period) as top
    from runs group by doc_id
), dropped as (
    select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
    select p.doc_id, string_agg(p.word, ' ' order by p.i) as text
    from (select doc_id, unnest(words) as word, unnest(range(n)) as i from planted) p anti join dropped d on p.doc_id = d.doc_id and p.i = d.i
    group by p.doc_id
)
select p.doc_id, coalesce(l.n_runs, 0) as n_runs, cast(l.top.start as bigint) as start, cast(l.top.length as bigint) as length,
       cast(l.top.period as bigint) as period, cast(1000 * l.top.length // l.top.period as bigint) as exponent_milli,
       sha256(coalesce(l.lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from planted p left join listed l on p.doc_id = l.doc_id left join kept k on p.doc_id = k.doc_id
"""

ORACLES = {"op11_hard_negatives": OP11, "op13_periodic_runs": OP13}
