"""DuckDB SQL for the queries whose rows SQL can express on whole tables."""

SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win)
        WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS s, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
         ANTI JOIN cov USING (doc_id, p) GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {lower('text')} AS t FROM documents)
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({lower('text')}, '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
             FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)
        GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""


def _discount(n: str) -> str:
    """Good-Turing factors by count from a table (r, n) of counts of counts, r = 1..6."""
    return f"""
  (SELECT r, CASE WHEN bool_and(coalesce(d > 0 AND d <= 1, false)) OVER () THEN d ELSE 1 - 0.5 / r END AS d
   FROM (SELECT a.r, CASE WHEN a.n > 0 AND f.n > 0 AND 6.0 * s.n / f.n <> 1 THEN
                ((a.r + 1) * b.n / (a.r * a.n::DOUBLE) - 6.0 * s.n / f.n) / (1 - 6.0 * s.n / f.n) END AS d
         FROM {n} a, {n} b, {n} f, {n} s WHERE a.r <= 5 AND b.r = a.r + 1 AND f.r = 1 AND s.r = 6))"""


OP4 = f"""
WITH d AS (SELECT doc_id, {CRC32} % 10 = 0 AS held_out,
                  list_append(regexp_extract_all({lower('text')}, '{SPACE}'), ' ') AS w FROM documents),
tok AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(list_prepend(NULL::VARCHAR, w[:len(w) - 1])) AS h FROM d),
u AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out AND h IS NOT NULL GROUP BY h, w),
rs AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS r),
n1 AS (SELECT r, count(u.c) AS n FROM rs LEFT JOIN u ON u.c = r GROUP BY r),
n2 AS (SELECT r, count(b.c) AS n FROM rs LEFT JOIN b ON b.c = r GROUP BY r),
d1 AS {_discount('n1')},
d2 AS {_discount('n2')},
t AS (SELECT sum(c) AS n, count(*) AS v FROM u),
free1 AS (SELECT (1 + sum((1 - d) * d1.r * n1.n)) / (max(t.n) + 1) AS p FROM d1 JOIN n1 USING (r), t),
p1 AS (SELECT w, c, coalesce(d, 1) * c / (t.n + 1) AS p FROM u LEFT JOIN d1 ON r = c, t),
p2 AS (SELECT h, b.w, b.c, coalesce(d, 1) * b.c / (hc.c + 1) AS p, p1.p AS low,
              CASE WHEN d IS NULL THEN 0 ELSE (1 - d) * b.c END AS freed
       FROM b LEFT JOIN d2 ON r = b.c JOIN u hc ON hc.w = h JOIN p1 ON p1.w = b.w),
a AS (SELECT h, (1 + sum(freed)) / (max(u.c) + 1) / (1 - sum(low)) AS a FROM p2 JOIN u ON u.w = h GROUP BY h),
s AS (SELECT tok.doc_id, tok.held_out, p1.c AS c, t.n AS n, t.v AS v,
             CASE WHEN tok.h IS NULL OR (p2.p IS NULL AND a.a IS NULL) THEN coalesce(p1.p, free1.p)
                  ELSE coalesce(p2.p, a.a * coalesce(p1.p, free1.p)) END AS p
      FROM tok CROSS JOIN t CROSS JOIN free1 LEFT JOIN p1 ON p1.w = tok.w
           LEFT JOIN p2 ON p2.h = tok.h AND p2.w = tok.w LEFT JOIN a ON a.h = tok.h)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known,
       any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score,
       sum(log10(p)) AS score
FROM s GROUP BY doc_id
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k AS size, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, g, f AS a, string_split(g, ' ') AS w FROM f WHERE size >= 2),
cut AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
             JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.k], ' ')
             JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.k + 1:], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, max(a) AS f
           FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2))
           GROUP BY ALL),
kept AS (SELECT worst.*, n.n FROM worst JOIN n USING (lang) LEFT JOIN longer USING (lang, g)
         WHERE longer.f IS NULL OR 100 * longer.f < 80 * worst.a)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept) WHERE rank <= 2000
"""
