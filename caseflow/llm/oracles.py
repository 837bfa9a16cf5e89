"""The same results in SQL, for small tables, for operators that SQL can express."""

from __future__ import annotations

from caseflow.llm.licenses import LEAST_SHARE, MOST_GAP, PHRASES, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10"""

#: Pairs ``l(a, b)`` in both directions, and ids ``n(id)``: the smallest id that each reaches.
REACHED = """reach(id, c) AS (SELECT id, id FROM n UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.id),
component AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT vec_id AS id FROM embeddings), {REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component"""

SHINGLES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
h AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS i FROM h p JOIN h q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * i >= 85 * (n + m - i)),
n AS (SELECT doc_id AS id FROM documents), {REACHED}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id FROM s JOIN component ON id = s.doc_id"""


def licenses() -> str:
    rows = []
    for k, (exact, label, text) in enumerate([(True, label, p) for p, label in PHRASES.items()] + [(False, label, t) for label, many in TEMPLATES.items() for t in many]):
        words = text.split()
        rows += [f"({k}, {exact}, '{label}', {len(words) - 1}, {i}, '{a} {b}')" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return f"""
WITH t(template, exact, label, pairs, spot, pair) AS (VALUES {", ".join(rows)}),
w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'pos': i - 1, 'pair': w[i] || ' ' || w[i + 1]}})) AS x FROM w),
h AS (SELECT doc_id, x.pos AS pos, t.* FROM p JOIN t ON t.pair = x.pair),
d AS (SELECT doc_id, template, exact, label, pairs, pos - spot AS diagonal, list(DISTINCT spot) AS ats, min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
m AS (SELECT *, coalesce(exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {MOST_GAP}, true) AS fresh FROM d),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM m),
s AS (SELECT doc_id, exact, label, pairs, len(list_distinct(flatten(list(ats)))) AS found, min(low) AS low, max(high) AS high FROM g GROUP BY doc_id, template, exact, label, pairs, island),
o AS (SELECT *, least(found / CAST(pairs AS DOUBLE), 1.0) AS share FROM s
      WHERE CASE WHEN exact THEN found = pairs ELSE found / CAST(pairs AS DOUBLE) >= {LEAST_SHARE} AND high - low < pairs + {2 * MOST_GAP} END)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(*) FILTER (o.exact) AS n_base, CAST(min(low) FILTER (o.exact) AS BIGINT) AS first_word, CAST(max(low) FILTER (o.exact) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (o.exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0::DOUBLE) AS score
FROM w LEFT JOIN o ON o.doc_id = w.doc_id GROUP BY w.doc_id"""
