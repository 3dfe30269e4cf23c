"""DuckDB SQL of those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_NAME = "nullif(nullif(lower(trim(regexp_replace(author, '[\\t-\\r \\x{85}\\x{a0}]+', ' ', 'g'), ' ')), ''), 'unknown')"

_AUTHORS = f"""a AS (SELECT DISTINCT CASE WHEN trim(source_doc_id, ' ') <> '' THEN source_doc_id END AS s, {_NAME} AS n FROM chunk),
e AS (SELECT DISTINCT x.n AS a, y.n AS b FROM a x JOIN a y ON x.s = y.s AND x.n <> y.n),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a AS author, least(a, min(b)) AS root FROM c WHERE a <> b GROUP BY a)"""
_SPACED = "' ' || chr(9) || chr(13) || chr(10)"

SQL: dict[str, str] = {
    "p1_found": """WITH r AS (
  SELECT 'essays' AS rec_table, article_id AS rec_key, min(text) AS text FROM essays WHERE article_id IS NOT NULL GROUP BY article_id
  UNION ALL SELECT 'recreation', CAST(rec_id AS VARCHAR), min(body) FROM recreation WHERE rec_id IS NOT NULL GROUP BY rec_id),
w AS (SELECT rec_table, rec_key, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM r WHERE text IS NOT NULL),
s AS (SELECT rec_table, rec_key, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT rec_table, rec_key, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM s),
k AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT rec_table || ' ' || rec_key) > 1),
f AS (SELECT *, lag(i) OVER (PARTITION BY rec_table, rec_key ORDER BY i) AS p FROM h SEMI JOIN k USING (h)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_table, rec_key ORDER BY i) AS run FROM f)
SELECT rec_table, rec_key, min(i) AS first_word, max(i) + 50 - min(i) AS n_words FROM g GROUP BY rec_table, rec_key, run""",
    "p2_found": f"""WITH RECURSIVE {_AUTHORS}
SELECT a AS author_a, b AS author_b FROM c WHERE a < b""",
    "p3_found": """SELECT DISTINCT 'essays' AS item_table, article_id AS item_id FROM essays
WHERE article_id IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) > 1200
UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM chunk WHERE chunk_id IS NOT NULL AND len(tokens) > 400""",
    "p2_members": f"WITH RECURSIVE {_AUTHORS} SELECT author, root FROM m",
    "p2_splits": f"""WITH RECURSIVE {_AUTHORS},
each AS (SELECT DISTINCT chunk_id AS k, CASE WHEN trim(source_doc_id, ' ') <> '' THEN source_doc_id END AS s, {_NAME} AS n FROM chunk),
r AS (SELECT DISTINCT n, 'author:' || coalesce(m.root, n) AS root FROM a LEFT JOIN m ON a.n = m.author WHERE n IS NOT NULL),
b AS (SELECT s, min(root) AS root FROM each JOIN r USING (n) WHERE s IS NOT NULL GROUP BY s),
placed AS (SELECT DISTINCT k, s, coalesce(b.root, 'source:' || s) AS root FROM each LEFT JOIN b USING (s) WHERE s IS NOT NULL
  UNION SELECT k, s, coalesce(r.root, 'row:' || coalesce(k, '')) FROM each LEFT JOIN r USING (n) WHERE s IS NULL),
sized AS (SELECT root, count(*) AS size, floor(log2(count(*))) AS band FROM placed GROUP BY root),
deal AS (SELECT root, (CAST(sum(size) OVER (PARTITION BY band ORDER BY md5(root), root ROWS UNBOUNDED PRECEDING) AS DOUBLE) - size / 2.0) / CAST(sum(size) OVER (PARTITION BY band) AS DOUBLE) AS x FROM sized)
SELECT k AS chunk_id, s AS source_doc_id, root, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'validation' ELSE 'test' END AS split FROM placed JOIN deal USING (root)""",
    "p3_pieces": f"""WITH RECURSIVE texts AS (SELECT article_id AS id, regexp_extract_all(min(text), '[ \\t\\r\\n]*[^ \\t\\r\\n]+') AS u FROM essays WHERE article_id IS NOT NULL GROUP BY article_id),
words AS (SELECT id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM texts WHERE len(u) > 1200),
followed AS (SELECT id, i, ltrim(x, {_SPACED}) AS w, lead(x) OVER (PARTITION BY id ORDER BY i) AS y FROM words),
ranked AS (SELECT 'essays' AS item_table, id, i, CASE WHEN y IS NULL OR len(regexp_extract_all(y, '\\n')) > 1 OR w LIKE '%</p>' THEN 4
    WHEN regexp_matches(w, '[.!?…。！？]["''”’»)\\]]*(?:</\\w+>)*$') THEN 3 WHEN contains(y, chr(10)) THEN 2 WHEN regexp_matches(w, '[,;:—–]["''”’»)\\]]*$') THEN 1 ELSE 0 END AS strength FROM followed),
lists AS (SELECT DISTINCT ON (chunk_id) chunk_id AS id, list_transform(tokens, lambda x: coalesce(x, '')) AS u FROM chunk WHERE chunk_id IS NOT NULL AND len(tokens) > 400),
marks AS (SELECT id, unnest(u) AS t, generate_subscripts(u, 1) AS i FROM lists),
own AS (SELECT id, i, t IN ('"', '''', '”', '’', '»', ')', ']') AS closer, CASE WHEN t IN ('"', '''', '”', '’', '»', ')', ']') THEN NULL WHEN regexp_matches(t, '[.!?…]$') THEN 3 WHEN t IN (',', ';', ':', '—', '–') THEN 1 ELSE 0 END AS b FROM marks),
ended AS (SELECT id, i, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS b, coalesce(lead(closer) OVER (PARTITION BY id ORDER BY i), false) AS moved FROM own),
strengths AS (SELECT item_table, id, list(strength ORDER BY i) AS s FROM ranked GROUP BY ALL UNION ALL SELECT 'chunk', id, list(CASE WHEN moved THEN 0 ELSE b END ORDER BY i) FROM ended GROUP BY id),
items AS (SELECT item_table, id, s, len(s) AS n, CASE item_table WHEN 'essays' THEN 1200 ELSE 400 END AS size, CASE item_table WHEN 'essays' THEN 60 ELSE 40 END AS overlap FROM strengths),
cut AS (SELECT item_table, id, 0 AS piece, CAST(0 AS BIGINT) AS f, CASE WHEN n <= size THEN n ELSE size + 1 - list_position(list_reverse(s[size // 2 : size]), list_max(s[size // 2 : size])) END AS stop FROM items
  UNION ALL SELECT item_table, id, piece + 1, f, CASE WHEN n - f <= size THEN n ELSE f + size + 1 - list_position(list_reverse(s[f + size // 2 : f + size]), list_max(s[f + size // 2 : f + size])) END
  FROM (SELECT item_table, id, piece, stop - overlap AS f, s, n, size FROM cut JOIN items USING (item_table, id) WHERE stop < n))
SELECT item_table, id AS item_id, CAST(piece AS INTEGER) AS piece, CAST(f AS INTEGER) AS first_unit, CAST(stop - f AS INTEGER) AS n_units,
  ['none', 'clause', 'line', 'sentence', 'paragraph'][CASE WHEN stop = n THEN 5 ELSE s[stop] + 1 END] AS cut,
  CASE item_table WHEN 'essays' THEN ltrim(array_to_string(texts.u[f + 1 : stop], ''), {_SPACED}) ELSE array_to_string(lists.u[f + 1 : stop], ' ') END AS text
FROM cut JOIN items USING (item_table, id) LEFT JOIN texts USING (id) LEFT JOIN lists USING (id)""",
}

SQL["p1_shared"] = f"""WITH found AS ({SQL['p1_found']}),
total AS (SELECT rec_table, rec_key, CAST(sum(n_words) AS BIGINT) AS n FROM found GROUP BY ALL),
sized AS (SELECT 'essays' AS rec_table, article_id AS rec_key, min(text) AS text FROM essays WHERE article_id IS NOT NULL GROUP BY article_id
  UNION ALL SELECT 'recreation', CAST(rec_id AS VARCHAR), min(body) FROM recreation WHERE rec_id IS NOT NULL GROUP BY rec_id),
counted AS (SELECT rec_table, rec_key, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS words FROM sized)
SELECT rec_table, rec_key, words, coalesce(n, 0) AS shared_words, CASE WHEN words > 0 THEN coalesce(n, 0) / words ELSE 0.0 END AS share FROM counted LEFT JOIN total USING (rec_table, rec_key)"""
