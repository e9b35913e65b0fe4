"""Named queries of the operators for training data, and SQL that states the same where SQL can.

Tokens, alignments, annealing and packing have no SQL; tests hold them against real encoders,
tables of other algorithms and invariants.
"""

from __future__ import annotations

from corpusmill.llm import mixing, neardup, overlap, packing, quality, splits, tokens, turns
from corpusmill.plans.corpus import NEAR, SOURCE, squeezed_sql

QUERIES = {
    "p1_found": overlap.found,
    "p1_overlap_report": overlap.report,
    "p2_token_budget": tokens.budget,
    "p2_tokens_per_record": tokens.per_record,
    "p3_found": splits.found,
    "p3_assignment": splits.assignment,
    "p3_report": splits.report,
    "p4_found": neardup.found,
    "p4_groups": neardup.groups,
    "p5_found": turns.found,
    "p5_report": turns.report,
    "p6_placement": packing.placement,
    "p6_report": packing.report,
    "p7_mixture": mixing.mixture,
    "p7_report": mixing.report,
    "p8_found": quality.found,
    "p8_statistics": quality.statistics,
}

#: pic(id, v): the pictures of records.
_PLAIN_HASH = "regexp_replace(lower(trim(phash, ' ')), '^0x', '')"
_PICTURES = f"pic AS (SELECT DISTINCT id, ('0x' || lpad({_PLAIN_HASH}, 16, '0'))::UBIGINT AS v FROM image_bands WHERE regexp_matches({_PLAIN_HASH}, '^[0-9a-f]{{1,16}}$'))"
_GROUPS = "e{k} AS (SELECT x, y FROM {pairs} UNION SELECT y, x FROM {pairs}), c{k}(x, r) AS (SELECT DISTINCT x, x FROM e{k} UNION SELECT e{k}.y, c{k}.r FROM c{k} JOIN e{k} ON c{k}.x = e{k}.x WHERE c{k}.r < e{k}.y), m{k} AS (SELECT x AS id, min(r) AS root FROM c{k} GROUP BY x)"

#: b(t, e): training and evaluation records with one opening question.
_QUESTIONS = f"""j AS (SELECT id, split, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r WHERE split IS NOT NULL),
f AS (SELECT id, split, list_filter((p->'turns')::JSON[], lambda z: (z->>'role') = 'user')[1]->>'content' AS q, CASE WHEN json_array_length(p, '$.media') > 0 THEN array_to_string(list_transform((p->'media')::JSON[], lambda z: coalesce(z->>'rgb_sha256', 'None')), '|') ELSE '' END AS m FROM j WHERE json_array_length(p, '$.turns') > 0),
k AS (SELECT id, split, regexp_replace({squeezed_sql("q")}, '[，。！？,.!?]', '', 'g') AS q, m FROM f WHERE {squeezed_sql("q")} <> ''),
b AS (SELECT a.id AS t, b.id AS e FROM k a JOIN k b ON a.q = b.q AND a.m = b.m AND a.split = 'train' AND b.split IN ('val', 'test'))"""

ORACLES = {
    "p1_found": f"""WITH {NEAR}, {_QUESTIONS}
SELECT x AS id_a, y AS id_b FROM near JOIN r a ON a.id = x JOIN r b ON b.id = y WHERE (a.split = 'train' AND b.split IN ('val', 'test')) OR (b.split = 'train' AND a.split IN ('val', 'test')) UNION SELECT least(t, e), greatest(t, e) FROM b""",
    "p1_overlap_report": f"""WITH {NEAR}, {_QUESTIONS}, w AS (SELECT a.id AS t, b.id AS e FROM near JOIN r a ON a.id IN (x, y) JOIN r b ON b.id IN (x, y) AND a.id <> b.id WHERE a.split = 'train' AND b.split IN ('val', 'test')),
p AS (SELECT id AS e, s, unnest(generate_series(1, greatest(1, length(s) - 4))) AS i FROM t WHERE id IN (SELECT e FROM w)), h AS (SELECT DISTINCT p.e, s, i FROM p JOIN w USING (e) JOIN g ON g.id = w.t AND g.g = substr(s, i, 5)),
c AS (SELECT e, count(DISTINCT k) / any_value(length(s)) AS coverage FROM (SELECT e, s, unnest(generate_series(i, least(i + 4, length(s)))) AS k FROM h) GROUP BY e), m AS (SELECT e, count(*) AS n FROM w GROUP BY e), q AS (SELECT e, count(*) AS q FROM b GROUP BY e)
SELECT split, {SOURCE} AS source, count(*) AS records, count(coalesce(n, q)) AS overlapping, coalesce(sum(n), 0)::BIGINT AS near_pairs, coalesce(sum(q), 0)::BIGINT AS question_pairs, round(avg(coverage), 4) AS mean_coverage FROM r LEFT JOIN m ON m.e = id LEFT JOIN q ON q.e = id LEFT JOIN c ON c.e = id WHERE split IN ('val', 'test') GROUP BY 1, 2""",
    "p3_found": f"""WITH RECURSIVE r AS (SELECT DISTINCT id, group_root, split FROM samples), k AS (SELECT DISTINCT id, 'k:' || {squeezed_sql("key")} AS key FROM links WHERE id IN (SELECT id FROM r) UNION SELECT id, 'r:' || {squeezed_sql("group_root")} FROM r),
s AS (SELECT id AS x, min(id) OVER (PARTITION BY key) AS y FROM k WHERE key NOT IN ('k:', 'r:')), {_GROUPS.format(k="", pairs="s")}
SELECT id FROM m WHERE root IN (SELECT root FROM m JOIN r USING (id) GROUP BY root HAVING count(DISTINCT split) > 1)""",
    "p4_found": f"""WITH {NEAR}, {_PICTURES}
SELECT 'text' AS kind, x AS id_a, y AS id_b FROM near UNION ALL SELECT DISTINCT 'image', a.id, b.id FROM pic a JOIN pic b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 6""",
    "p4_groups": f"""WITH RECURSIVE {NEAR}, {_PICTURES}, alike AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM pic a JOIN pic b ON bit_count(xor(a.v, b.v)) <= 6 AND (a.id <> b.id OR a.v <> b.v) GROUP BY 1, 2), other AS (SELECT x, y FROM alike WHERE x < y),
{_GROUPS.format(k="t", pairs="near")}, {_GROUPS.format(k="p", pairs="other")}, l AS (SELECT id, count(*) AS links FROM (SELECT x AS id FROM near UNION ALL SELECT y FROM near) GROUP BY id), q AS (SELECT x AS id, sum(n)::BIGINT AS links FROM alike GROUP BY x)
SELECT 'text' AS kind, id, root AS group_id, links FROM mt JOIN l USING (id) UNION ALL SELECT 'image', id, root, links FROM mp JOIN q USING (id)""",
}
