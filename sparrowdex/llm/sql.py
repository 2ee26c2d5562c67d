"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

import re

from .licenses import PHRASES, TEMPLATES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], chr(1)))) END AS s FROM d),
u AS (SELECT rid, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.x = b.x AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rid, rid AS r FROM s UNION SELECT reach.rid, p.b FROM reach JOIN p ON reach.r = p.a),
low AS (SELECT reach.rid, min(s.doc_id) AS component_id FROM reach JOIN s ON s.rid = reach.r GROUP BY reach.rid)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN low USING (rid)"""

VECTORS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT rid, rid AS r FROM v UNION SELECT reach.rid, p.b FROM reach JOIN p ON reach.r = p.a),
low AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.r GROUP BY reach.rid),
n AS (SELECT a AS rid, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN low USING (rid) LEFT JOIN n USING (rid)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _words(text: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def licenses(k: int = 3, share: float = 0.8, slack: int = 3) -> str:
    table = ", ".join(f"({i}, '{label}', {_list(_words(text))})" for i, (label, text) in enumerate(TEMPLATES))
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {j}] = '{x}'" if j else f"w[i] = '{x}'" for j, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(generate_series(1, len(w)), lambda i: coalesce({test}, false)), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    base = "flatten([" + ", ".join(places) + "])"
    gram = lambda i: f"array_to_string(w[{i}:{i} + {k - 1}], ' ')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT rid, doc_id, w, {base} AS base FROM d),
t AS (SELECT * FROM (VALUES {table}) AS t(template, label, w)),
tg AS (SELECT template, label, len(w) AS tsize, i - 1 AS tpos, {gram('i')} AS gram FROM t, unnest(generate_series(1, len(w) - {k - 1})) AS x(i)),
dg AS (SELECT rid, i - 1 AS pos, {gram('i')} AS gram FROM d, unnest(generate_series(1, len(w) - {k - 1})) AS x(i)),
votes AS (SELECT rid, template, label, tsize, pos - tpos AS diagonal, min(pos) AS lo, max(pos) + {k} AS hi, list(DISTINCT tpos) AS held FROM dg JOIN tg USING (gram) GROUP BY ALL),
news AS (SELECT *, CASE WHEN coalesce(abs(diagonal - lag(diagonal) OVER s) > {slack} OR lo - max(hi) OVER (PARTITION BY rid, template ORDER BY lo, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {slack + k}, true) THEN 1 ELSE 0 END AS new FROM votes WINDOW s AS (PARTITION BY rid, template ORDER BY lo, diagonal)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY lo, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM news),
spans AS (SELECT rid, template, label, min(lo) AS lo, max(hi) AS hi, len(list_distinct(flatten(list_transform(flatten(list(held)), lambda p: generate_series(p, p + {k - 1}))))) / greatest(tsize, max(hi) - min(lo)) AS similarity FROM numbered GROUP BY rid, template, label, tsize, span),
good AS (SELECT * FROM spans WHERE similarity >= {share}),
best AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h WHERE h.rid = g.rid AND h.lo < g.hi AND g.lo < h.hi AND (h.similarity > g.similarity OR (h.similarity = g.similarity AND h.hi - h.lo > g.hi - g.lo AND h.label <> g.label)))),
added AS (SELECT rid, list(label) AS labels, max(similarity) AS similarity FROM best GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(list_transform(base, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(base, lambda x: x.at))::BIGINT AS last_word,
 array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda x: x.label), coalesce(labels, []::VARCHAR[])))), ',') AS labels,
 CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE least(coalesce(similarity, 0.0), 1.0)::DOUBLE END AS score FROM b LEFT JOIN added USING (rid)"""


ORACLE_SQL = {"op3_minhash_near_dedup": NEAR, "op4_license_scans": licenses(), "op6_embedding_near_dedup": VECTORS}
