"""DuckDB SQL for the queries that SQL can express."""

#: Smallest id reachable over links (a, b), for the ids of ``every``.
_REACH = """
reach AS (
  SELECT id AS root, id AS node FROM every
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT root AS id, min(node) AS component_id FROM reach GROUP BY root)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDING = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT p.id AS a, q.id AS b FROM v p JOIN v q
  ON p.id <> q.id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.9
), every AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.id) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM comp c
"""

NGRAM = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id
  JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = q.doc_id
  GROUP BY p.doc_id, q.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), every AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM comp c LEFT JOIN n ON n.doc_id = c.id
"""

_CLASS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATION = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_CLASS}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
    ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS g FROM b
), sizes AS (SELECT DISTINCT len(g) AS m FROM win),
d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_CLASS}') AS w FROM documents
), runs AS (
  SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes)
), found AS (SELECT DISTINCT r.doc_id, r.i, r.m, win.item_id FROM runs r JOIN win ON win.g = r.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOOL_CALLS = """
WITH asked AS (
  SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), said AS (
  SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), chain AS (
  -- calls two turns apart form a run; the level is the place in it
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM asked)
), lev AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * r ORDER BY turn) - 1 AS level FROM chain
), j AS (
  SELECT coalesce(a.conv_id, NULL) AS conv_id, coalesce(a.conv_id, s.conv_id) || ':' || coalesce(a.turn, s.turn - 1) AS call_id,
    l.level, s.turn AS seq, a.text AS prompt, a.turn AS turn, s.text AS content, a.conv_id IS NULL AS orphan,
    CASE WHEN l.level > 0 THEN a.conv_id || ':' || (a.turn - 2) END AS after
  FROM asked a LEFT JOIN lev l USING (conv_id, turn) FULL JOIN said s ON s.conv_id = a.conv_id AND s.turn = a.turn + 1
), st AS (
  SELECT *, CASE WHEN orphan THEN 'orphan' WHEN prompt IS NULL THEN 'invalid_arguments' WHEN content IS NULL THEN 'unanswered' ELSE 'ok' END AS status FROM j
)
SELECT conv_id, call_id, level, seq, status,
  '{"after":' || coalesce(to_json(after)::VARCHAR, 'null') || ',"arguments":'
  || CASE WHEN orphan THEN 'null' ELSE '{"prompt":' || coalesce(to_json(prompt)::VARCHAR, 'null') || ',"turn":' || turn || '}' END
  || ',"call_id":' || to_json(call_id)::VARCHAR || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null')
  || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || CASE WHEN orphan THEN 'null' ELSE '"answer"' END
  || ',"status":"' || status || '"}' AS line
FROM st
UNION ALL
SELECT DISTINCT conv_id, NULL, NULL, turn, 'context',
  '{"after":null,"arguments":null,"call_id":null,"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"level":null,"name":null,"status":"context"}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

PHRASES = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n), cut) AS place
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cut + 1:], ' ')
), inside AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS n FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT s.lang, s.phrase, a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE place = 1 AND (i.n IS NULL OR 100 * i.n < 50 * a)
), n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT kept.lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op4_embedding_range_join": EMBEDDING,
    "op6_ngram_jaccard_join": NGRAM,
    "op10_tool_calls": TOOL_CALLS,
    "op9_suffix_decontamination": DECONTAMINATION,
    "op11_phrase_collocations": PHRASES,
}
