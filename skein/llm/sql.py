"""DuckDB SQL of the queries that SQL expresses."""

OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM t
),
win AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM m, range(1, len(w) - 1) AS r(p))
),
rep AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM win WHERE n > 1) GROUP BY doc_id
),
g AS (
  SELECT m.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         length(t)::BIGINT AS n_chars, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)
),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 2 * n_chars)::INT
    + 8 * (100 * n_capitals > 30 * n_chars)::INT + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT
    + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT AS bits
  FROM g
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits & 7 = 0 AS kept_before,
       CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'capitals'
         WHEN 16 THEN 'repeated_lines' WHEN 32 THEN 'short_words' WHEN 64 THEN 'long_words' END AS sole_rule,
       bits::BIGINT AS fail_bits
FROM b
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
),
s AS (SELECT src, none, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY none, src) - 1) % 3 + 1] AS weight FROM s),
r AS (
  SELECT *, words * 2 / weight AS ratio,
         1.5::DOUBLE * sum(words) OVER () - coalesce(sum(words * 2) OVER (ORDER BY words * 2 / weight, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY words * 2 / weight, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
),
level AS (SELECT room, open FROM r WHERE room / open <= ratio ORDER BY ratio, none, src LIMIT 1),
t AS (
  SELECT src, none, words, CASE WHEN level.room IS NULL OR weight * level.room / level.open >= words * 2 THEN words * 2.0::DOUBLE ELSE weight * level.room / level.open END AS target,
         ('0x' || substr(md5('mix-1|' || src || '|' || none::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM r LEFT JOIN level ON true
),
p AS (SELECT *, length(bin(size + 1)) AS power, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT % 64 AS bucket FROM d),
k AS (
  SELECT p.*, words, target, start, CASE WHEN words > 0 THEN target / words ELSE 0 END AS each,
         row_number() OVER (PARTITION BY src, none ORDER BY power * 8 + floor((size + 1) * 8 / 2.0::DOUBLE ** (power - 1)), bucket, size, doc_id) AS n
  FROM p JOIN t USING (src, none)
)
SELECT doc_id, size, words AS source_size, target, ((floor(n * each + start) - floor((n - 1) * each + start)) * size)::BIGINT AS taken FROM k
"""

SQL = {"op1_quality_rules": OP1, "op4_mixing": OP4}
