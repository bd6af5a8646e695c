"""SQL, as DuckDB runs it, for the operators whose whole result SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts AS c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) AS g),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * s.v)::HUGEINT AS p,
    1 + (1000000000 * (k.lang_n + 5)::HUGEINT) // (s.lang_total + 5 * s.v)::HUGEINT AS q
  FROM groups AS g JOIN kept AS k USING (lang) JOIN sizes AS s USING (lang) LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce((SELECT sum(abs(a.p - b.p)) FROM shares AS a JOIN shares AS b USING (lang, term) WHERE a.lang = g.lang AND a.source = g.source AND b.source = o.source), 0)::BIGINT AS value
  FROM groups AS g JOIN groups AS o ON o.lang = g.lang AND o.source <> g.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: The reflected polynomial of CRC-32; the table of its 256 steps is made by the rule.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps"

RESAMPLING = rf"""
WITH texts AS (
  SELECT 'd' AS part, row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
  SELECT part, row, unnest(words) AS feature FROM texts
  UNION ALL SELECT part, row, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM texts WHERE len(words) > 1),
counted AS (SELECT part, row, feature, count(*) AS n FROM features GROUP BY ALL),
crc AS (SELECT {_CRC_TABLE.removeprefix("SELECT ")}),
buckets AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS code FROM (SELECT DISTINCT feature FROM counted)), crc),
held AS (SELECT part, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (feature) GROUP BY ALL),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT b.bucket, coalesce(sum(n) FILTER (part = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (part = 'b'), 0)::BIGINT AS t FROM (SELECT unnest(range(10000)) AS bucket) AS b LEFT JOIN held USING (bucket) GROUP BY b.bucket)),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE part = 'd' GROUP BY row),
scored AS (
  SELECT d.doc_id, len(d.words) >= 20 AS able, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM texts AS d LEFT JOIN weights AS w USING (row) WHERE d.part = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
