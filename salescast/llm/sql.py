"""SQL of the corpus queries for another engine."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
placed AS (
  SELECT *, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER ahead, 0) AS cap_ahead,
    coalesce(sum(weight) OVER ahead, 0) AS weight_ahead,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM sources
  WINDOW ahead AS (ORDER BY 3 * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, CAST(total - cap_ahead AS DOUBLE) / CAST(weights - weight_ahead AS DOUBLE) AS level
  FROM placed),
shared AS (
  SELECT min_by(level, cap_ahead + weight_ahead) AS level FROM leveled WHERE cap > level * weight),
goals AS (
  SELECT l.source, source_size,
    CASE WHEN s.level IS NULL THEN CAST(cap AS DOUBLE)
      ELSE least(CAST(cap AS DOUBLE), s.level * weight) END AS target,
    CAST('0x' || substr(md5('17:' || coalesce('=' || l.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS start
  FROM leveled l CROSS JOIN shared s),
rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.start,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0) ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST((floor((place + 1) * rate + start) - floor(place * rate + start)) * size AS BIGINT) AS taken
FROM rated
"""

SEARCH = """
WITH codes AS (
  SELECT DISTINCT vec_id, CAST(list_sum(list_transform(range(64),
    lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END)) AS UBIGINT) AS code
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, distance,
  row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
FROM pairs
QUALIFY rank <= 10
"""

INTERACTION = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
fails AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    d.doc_id > min(d.doc_id) OVER (PARTITION BY text) AS e,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM texts d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cells AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(coalesce(e, false) AS INT) AS mask,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[:step]) AS INT) - bits[step] AS ahead
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
parts AS (SELECT DISTINCT part FROM cells),
told AS (
  SELECT p.part, s.filter_order, s.step, s.bit,
    coalesce(sum(n) FILTER ((mask & (ahead | bit)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & ahead) = 0), 0) AS removed,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & ahead) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & ahead) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & bit) > 0 AND (mask & ahead) = 0), 0) AS toxic_lost
  FROM parts p CROSS JOIN steps s JOIN cells c ON c.part = p.part
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""
