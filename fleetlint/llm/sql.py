"""DuckDB SQL with the same results, for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_IDENT = r"""(?i)(?:client_?id|user_?name|user|account|login|key_?id)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]{3,})"""
_WEAK = (r"""(?i)(?:password|passwd|passphrase|pwd|secret|token|api_?key|private_?key|credential)["'']?\x20*[:=]\x20*["'']?"""
         r"""([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""")
_ENDPOINT = (r"""(?:(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"''<>]{3,}"""
             r"""|(?i:host|hostname|endpoint|server)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9.:_-]{4,})""")
_KINDS = [("assign", _ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16),
          ("ident", _IDENT, 0, 0), ("weak", _WEAK, 0, 0), ("endpoint", _ENDPOINT, 0, 0)]


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v,
        unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0)
          + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT))) AS start
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs,
              regexp_split_to_array(text, '{pattern}') AS ps FROM d))
    WHERE length(v) >= {least}"""


SECRETS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), parts AS ("
    + " UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS)) + """),
near AS (SELECT *,
    coalesce(start - max(CASE WHEN rank IN (1, 3) THEN stop END) OVER back <= 300, false)
      OR coalesce(min(CASE WHEN rank IN (1, 3) THEN start END) OVER ahead - stop <= 300, false) AS ident,
    coalesce(start - max(CASE WHEN rank IN (0, 2, 4) THEN stop END) OVER back <= 300, false)
      OR coalesce(min(CASE WHEN rank IN (0, 2, 4) THEN start END) OVER ahead - stop <= 300, false) AS secret,
    coalesce(start - max(CASE WHEN rank = 5 THEN stop END) OVER back <= 300, false)
      OR coalesce(min(CASE WHEN rank = 5 THEN start END) OVER ahead - stop <= 300, false) AS endpoint,
    coalesce(max(CASE WHEN rank < 3 THEN stop END) OVER back, 0) > start AS covered
  FROM parts WINDOW back AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    ahead AS (PARTITION BY doc_id ORDER BY start DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (SELECT * FROM near WHERE rank < 3 OR (rank = 3 AND secret) OR (rank = 4 AND (ident OR endpoint) AND NOT covered)
  OR (rank = 5 AND ident AND secret)),
per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)
""")

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
ids AS (SELECT s, list(doc_id) AS docs FROM sets GROUP BY s HAVING count(*) > 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM (SELECT s, unnest(docs) AS doc_id FROM ids) a
    JOIN (SELECT s, unnest(docs) AS doc_id FROM ids) b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, n
"""

HARD_NEGATIVES = r"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS alabel, r.vec_id, r.label,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(r.v)) + 1), lambda i: a.v[i] * r.v[i])), 0) AS BIGINT) AS score
  FROM a, r),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s
    WHERE label = alabel AND vec_id <> anchor_id) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.alabel
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES = {"op13_hard_negatives": HARD_NEGATIVES, "op4_near_dedup": NEAR_DEDUP, "op2_exact_dedup": EXACT_DEDUP, "op9_secrets": SECRETS}
