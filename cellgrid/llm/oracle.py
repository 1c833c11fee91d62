"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math

from .licenses import PHRASES, TEMPLATES, THRESHOLD

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({low}, '{_GAP}'), lambda w: w <> '')"


OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
b AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to, url, '2008-01-02T03:04:05Z' AS date
FROM p LEFT JOIN b ON p.h = b.h
"""

_PLACES = ", ".join(
    f"list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + {len(p.split()) - 1}) = [{', '.join(repr(x) for x in p.split())}]) AS p{k}" for k, p in enumerate(PHRASES)
)
_ALL = " || ".join(f"p{k}" for k in range(len(PHRASES)))
_BASE = " || ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE [] END" for k, label in enumerate(PHRASES.values()))
_TEMPLATES = ", ".join(
    f"('{label}', [{', '.join(repr(x) for x in sorted(set(t.split())))}], {len(set(t.split()))}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)})" for label, t in TEMPLATES
)

OP7 = f"""
WITH d AS (SELECT doc_id, text, {_words('text')} AS w FROM documents),
places AS (SELECT doc_id, w, {_PLACES} FROM d),
base AS (SELECT doc_id, len(w) AS n_words, {_ALL} AS hit, list_sort(list_distinct({_BASE})) AS base FROM places),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS block, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
tokens AS (SELECT doc_id, block, list_distinct({_words('line')}) AS w FROM lines),
t(label, tokens, n, need) AS (VALUES {_TEMPLATES}),
found AS (SELECT doc_id, block, label, len(list_intersect(w, t.tokens)) / n AS c FROM tokens, t WHERE len(list_intersect(w, t.tokens)) >= need),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best, list_sort(list(DISTINCT block)) AS blocks FROM found GROUP BY doc_id)
SELECT b.doc_id, n_words, len(hit) AS n_base, list_min(hit) - 1 AS first_word, list_max(hit) - 1 AS last_word,
  array_to_string(base, ',') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ','), '') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score,
  coalesce(array_to_string(blocks, ','), '') AS blocks
FROM base b LEFT JOIN more m ON b.doc_id = m.doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""
