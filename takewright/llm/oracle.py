"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP8_MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS ord
  FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sources
), filled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS fills_at FROM weighed
), running AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS rest_weight
  FROM filled
  WINDOW before AS (ORDER BY fills_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (
  SELECT fills_at, ord, rest, rest_weight FROM running
  WHERE rest * weight / rest_weight < cap ORDER BY fills_at, ord LIMIT 1
), targets AS (
  SELECT r.source, r.source_size,
    CASE WHEN (r.fills_at, r.ord) >= (f.fills_at, f.ord) THEN f.rest * r.weight / f.rest_weight ELSE CAST(r.cap AS DOUBLE) END AS target
  FROM running r LEFT JOIN first f ON true
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT r.doc_id, r.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS extra,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""

OP3_TOP_K = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP5_SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs
), late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts
  ) WHERE nth > 1
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late
), told AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM told ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP10_JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE s.n * 10 >= 8 * (x.n + y.n - s.n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM docs d
"""

OP12_MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n_chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS one_more,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    -- unsigned crc32 of the decimal digits: a byte at a time, a bit at a time
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || n_chars || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || one_more || tail) ELSE sha256(head || n_chars || tail) END AS shown FROM fields
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, idx, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
), climb AS (
  SELECT lang, idx AS leaf_idx, 0 AS level, idx, n, shown AS folded, '' AS siblings FROM ranked
  UNION ALL
  SELECT c.lang, c.leaf_idx, c.level + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN coalesce(s.digest, '') || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, '')
  FROM climb c LEFT JOIN nodes s ON c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND xor(c.idx, 1) = s.idx WHERE c.n > 1
), above AS (
  SELECT c.lang, c.leaf_idx, 0 AS level, r.idx, r.n, c.folded, c.siblings FROM climb c JOIN subroots r ON c.lang IS NOT DISTINCT FROM r.lang WHERE c.n = 1
  UNION ALL
  SELECT c.lang, c.leaf_idx, c.level + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN coalesce(s.digest, '') || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, '')
  FROM above c LEFT JOIN tops s ON c.level = s.level AND xor(c.idx, 1) = s.idx WHERE c.n > 1
)
SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, sha256(a.siblings) AS proof_sha256, a.folded AS folded_root, a.folded = t.digest AS verified
FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
JOIN above a ON r.lang IS NOT DISTINCT FROM a.lang AND r.idx = a.leaf_idx AND a.n = 1
JOIN tops t ON t.n = 1
"""
