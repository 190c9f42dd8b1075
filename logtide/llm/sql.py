"""SQL of the queries whose modules are long enough without it."""

JACCARD_COMPONENTS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS sh, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(least(x, y)) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""
LINE_DEDUP = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, i - 1 AS line, ls[i] AS body, regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
k AS (SELECT doc_id, line, body, w, len(w) AS n, CASE WHEN len(w) >= 1 THEN array_to_string(w, ' ') END AS k FROM o),
f AS (SELECT k, min((doc_id, line)) AS pos, any_value(w) AS w, any_value(n) AS n FROM k WHERE k IS NOT NULL GROUP BY k),
v AS (SELECT k, pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)),
m AS (SELECT v, i, n, min(pos) AS pos FROM v GROUP BY ALL HAVING count(*) > 1),
near AS (SELECT v.k FROM v JOIN m ON v.v = m.v AND v.i = m.i AND v.n = m.n WHERE v.pos > m.pos
  UNION SELECT v.k FROM v JOIN f ON v.v = f.k WHERE f.n >= 5 AND v.pos > f.pos UNION SELECT f.k FROM v JOIN f ON v.v = f.k WHERE f.n >= 5 AND f.pos > v.pos),
g AS (SELECT k.doc_id, k.line, k.body, k.k IS NOT NULL AND ((k.doc_id, k.line) <> f.pos OR near.k IS NOT NULL) AS gone FROM k LEFT JOIN f ON k.k = f.k LEFT JOIN near ON near.k = k.k)
SELECT documents.doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(x.kept, '') END AS text, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_gone, 0) AS n_gone
FROM documents LEFT JOIN (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) FILTER (NOT gone) AS kept, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_gone FROM g GROUP BY doc_id) x
  ON x.doc_id = documents.doc_id
"""
