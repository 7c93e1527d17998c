"""SQL of the queries over time, streams, sketches and groupings."""

from __future__ import annotations

from .oracle import NORMAL, ORACLES, SCORED_PARTS, WORKS, query, six, strip, words


def stamp(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def closed(delay: str) -> str:
    return f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} FROM events)"


ORACLES["arrivals_by_window"] = f"""
SELECT {stamp('s', '"start"')}, {stamp('s + INTERVAL 6 HOUR', '"end"')}, event_type, count(*) AS rows, round(sum(value), 2) AS value
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events)
WHERE s + INTERVAL 6 HOUR <= {closed('12 HOUR')} GROUP BY s, event_type"""
ORACLES["arrivals_by_sliding_window"] = f"""
SELECT {stamp('s', '"start"')}, {stamp('s + INTERVAL 2 DAY', '"end"')}, count(*) AS rows
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 1 DAY AS s FROM events, range(0, 2) AS t(back))
WHERE s + INTERVAL 2 DAY <= {closed('1 DAY')} GROUP BY s"""
ORACLES["arrival_sessions"] = query(
    marked="""
SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
    numbered="SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM marked",
    result=f"""
SELECT {stamp('min(ts)', '"start"')}, {stamp('max(ts) + INTERVAL 12 HOUR', '"end"')}, user_id, count(*) AS rows
FROM numbered GROUP BY user_id, n HAVING max(ts) + INTERVAL 12 HOUR <= {closed('1 DAY')}""",
)
ORACLES["arriving_first_works"] = query(
    all_works=WORKS,
    works="SELECT * FROM all_works WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1",
    result=f"SELECT seq, id, title, abstract, topics, primary_topic FROM ({NORMAL})",
)
ORACLES["checkpoint_at_event"] = query(
    metrics="SELECT user_id, ts, event_id, value FROM events WHERE event_type <> 'signup'",
    saved="SELECT user_id, ts, max(event_id) AS step, arg_max(value, event_id) AS saved FROM events WHERE event_type = 'signup' GROUP BY ALL",
    result=f"""
SELECT m.user_id, m.event_id, s.step, {six('m.value - s.saved', 'change')}
FROM metrics m ASOF LEFT JOIN saved s ON m.user_id = s.user_id AND m.ts >= s.ts""",
)
ORACLES["collections_in_one_pass"] = query(
    works=WORKS,
    selections="""
SELECT doc_id AS collection, d + CAST(doc_id * 7 % 2500 AS INTEGER) AS starts, doc_id % 4 < 3 AS has_start,
  d + CAST(doc_id * 7 % 2500 + doc_id % 90 AS INTEGER) AS ends, doc_id % 5 < 4 AS has_end,
  CASE WHEN doc_id % 3 > 0 THEN [source, lang] ELSE [] END AS topics, CASE WHEN quality = 1 THEN [lang] ELSE [] END AS concepts
FROM (SELECT *, DATE '2019-01-01' AS d FROM labels JOIN documents USING (doc_id))""",
    result="""
SELECT collection, count(*) AS works, min(seq) AS first, max(seq) AS last, CAST(sum(seq) AS BIGINT) AS seq_sum
FROM selections s JOIN works w ON (NOT has_start OR publication_date >= starts) AND (NOT has_end OR publication_date <= ends)
  AND (len(s.topics) = 0 OR list_has_any(coalesce(w.topic_keys, []), s.topics))
  AND (len(s.concepts) = 0 OR list_has_any(w.concept_keys, s.concepts))
GROUP BY collection""",
)
ORACLES["collect_one_selection"] = query(
    works=WORKS,
    taken="""
SELECT seq FROM works WHERE publication_date <= DATE '2024-06-30'
  AND list_has_any(coalesce(topic_keys, []), ['src1', 'src2', 'fr']) AND list_has_any(concept_keys, ['en', 'fr'])""",
    result="""SELECT seq, 'join' AS "by" FROM taken UNION ALL SELECT seq, 'predicate' FROM taken""",
)


def values(keys: str, source: str) -> str:
    tokens = words("prediction")
    return f"""
SELECT {keys}, 'prediction' AS measure, {strip('prediction')} AS value FROM {source}
UNION ALL SELECT {keys}, 'distinct_1', unnest({tokens}) FROM {source}
UNION ALL SELECT {keys}, 'distinct_2', unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
FROM (SELECT *, {tokens} AS t FROM {source})"""


ORACLES["diversity_from_sketches"] = query(
    **SCORED_PARTS,
    vals=values("run", "scored"),
    result="""
SELECT run, measure, count(*) AS total, count(DISTINCT value) AS "distinct", true AS within_2_percent FROM vals GROUP BY run, measure""",
)
ORACLES["diversity_by_grouping_sets"] = query(
    **SCORED_PARTS,
    tagged="SELECT s.run, s.split, CASE WHEN s.doc_id % 31 > 0 THEN d.lang END AS lang, prediction FROM scored s JOIN documents d USING (doc_id)",
    vals=values("run, split, lang", "tagged"),
    sets="""
SELECT run, split, lang, measure, count(DISTINCT value)::DOUBLE / count(*) AS ratio,
  concat_ws(',', CASE WHEN grouping(run) = 0 THEN 'run' END, CASE WHEN grouping(split) = 0 THEN 'split' END,
            CASE WHEN grouping(lang) = 0 THEN 'lang' END) AS "grouping"
FROM vals
GROUP BY GROUPING SETS ((run, split, lang, measure), (run, split, measure), (run, lang, measure), (run, measure), (lang, measure), (measure))""",
    result=f"""
SELECT "grouping", run, split, lang, {six("1 - max(ratio) FILTER (measure = 'prediction')", 'duplicate_rate')},
  {six("coalesce(max(ratio) FILTER (measure = 'distinct_1'), 0)", 'distinct_1')},
  {six("coalesce(max(ratio) FILTER (measure = 'distinct_2'), 0)", 'distinct_2')}
FROM sets GROUP BY "grouping", run, split, lang""",
)
