"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH h AS (SELECT page_id, url, coalesce(instr(url, '://'), 0) > 0 AS ok,
    CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS parts
  FROM pages),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END END AS canonical,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE ok AND regexp_extract(host, '^(?:www\.|blog\.|m\.)?([^.]*)', 1)
  IN ('adult-x', 'spam-farm', 'cheap-pills', 'ads-track', 'casino-win', 'free-bets'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""

EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w
    WHERE len(w) >= 3)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT s.anchor_id, s.vec_id AS positive_id, p.vec_id AS negative_id, s.score AS positive_score, p.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor_id, s.vec_id ORDER BY p.score DESC, p.vec_id) AS rank
  FROM pos s JOIN p ON p.anchor_id = s.anchor_id AND NOT p.same AND 30 * s.score <= 100 * p.score AND 100 * p.score <= 90 * s.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

MINHASH = (JACCARD_JOIN.replace("100 * c >= 90 *", "100 * c >= 85 *")
           .replace("AS component_id\n", "AS component_id, least(d.doc_id, coalesce(m.low, d.doc_id)) = d.doc_id AS kept\n"))

PREFIX_TRIE = """
WITH t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, bytes
  FROM (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
      strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)),
    4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
r0 AS (SELECT h.c, 0 AS half, t.pos, t.k, t.bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos < h.h
  UNION ALL SELECT h.c, 1, t.pos, t.k, t.bytes FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
paths AS (SELECT c, row_number() OVER w AS d, string_agg(k, '') OVER w AS p, bytes FROM r0 WINDOW w AS (PARTITION BY c ORDER BY half, pos)
  UNION ALL SELECT c, 0, '', 0 FROM h),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY p, d),
kids AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
under AS (SELECT a.p, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
  FROM nodes x LEFT JOIN kids ON kids.p = x.p JOIN paths a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.p),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS s FROM paths
  WHERE (c, d) IN (SELECT c, max(d) FROM paths GROUP BY c) GROUP BY p)
SELECT x.conv_id, x.d AS depth, q.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, CAST(under.n_leaves AS BIGINT) AS n_leaves,
  CAST(under.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends.s, sha256('')) AS ends_sha256
FROM nodes x JOIN under ON under.p = x.p LEFT JOIN kids ON kids.p = x.p LEFT JOIN ends ON ends.p = x.p
  LEFT JOIN nodes q ON x.d > 0 AND q.p = left(x.p, 32 * (x.d - 1))
"""
