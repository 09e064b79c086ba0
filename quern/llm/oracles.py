"""The registered queries as plain SQL, where SQL can express them: by brute force, with no hashes and no sketches."""

from __future__ import annotations

#: A-Z to lower case, and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[\x20\x09-\x0D]+'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_ROWS = "SELECT row_number() OVER () AS r, doc_id, text FROM documents"

SUBSTRING = rf"""
WITH d AS (SELECT r, doc_id, list_filter(string_split_regex(coalesce(text, ''), {_BLANK}), lambda x: x <> '') AS ws FROM ({_ROWS})),
s AS (SELECT r, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM d),
w AS (SELECT s.r, s.i, array_to_string(list_slice(ws, i, i + 34), ' ') AS w FROM s JOIN d USING (r)),
again AS (SELECT w FROM w GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM w JOIN again USING (w)),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

NEAR = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, {_BLANK}), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS s FROM p),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways AS e ON r.b = e.a) SELECT a, b FROM r),
least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

SUFFIX = rf"""
WITH d AS (SELECT r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM ({_ROWS})),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT r, unnest(range(0, greatest(n - 199, 0))) AS i FROM n),
w AS (SELECT s.r, s.i, md5(substr(h, 2 * i + 1, 400)) AS w FROM s JOIN n USING (r)),
again AS (SELECT w FROM w GROUP BY w HAVING count(*) > 1),
starts AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN again USING (w)),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM starts),
spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS kept_from FROM spans),
found AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN found USING (r)
"""

LINES = rf"""
WITH d AS (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM ({_ROWS})),
p AS (SELECT r, doc_id, ls, unnest(range(1, len(ls))) AS i FROM d),
w AS (SELECT r, doc_id, i, ls[i] || chr(10) || ls[i + 1] AS w FROM p),
first AS (SELECT w, min((doc_id, i)) AS f FROM w GROUP BY w HAVING count(*) > 1),
again AS (SELECT r, i FROM w JOIN first USING (w) WHERE doc_id <> f[1] OR i >= f[2] + 2),
gone AS (SELECT r, i AS k FROM again UNION SELECT r, i + 1 FROM again),
lines AS (SELECT r, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM d),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS t, count(*) AS n FROM lines ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

NEIGHBOURS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS score FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

CONTAMINATION = rf"""
WITH d AS (SELECT r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM ({_ROWS})),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM benchmark),
bi AS (SELECT item, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS w FROM bi),
sizes AS (SELECT DISTINCT size FROM bw),
di AS (SELECT r, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS i FROM d, sizes),
dw AS (SELECT r, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS w FROM di),
hits AS (SELECT r, i, size, item FROM dw JOIN bw USING (size, w)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING,
    "op4_near_dedup": NEAR,
    "op5_suffix_dedup": SUFFIX,
    "op7_line_dedup": LINES,
    "op9_nearest_neighbours": NEIGHBOURS,
    "op10_decontamination": CONTAMINATION,
}
