"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({text}, '[ \t-\r]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS a FROM documents),
i AS (SELECT doc_id, a, unnest(range(1, len(a))) AS i FROM w WHERE len(a) > 1),
sh AS (SELECT DISTINCT doc_id, a[i] || ' ' || a[i + 1] AS g FROM i UNION SELECT doc_id, a[1] FROM w WHERE len(a) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS at_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.at_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.at_id) AS component_id, r.doc_id = min(r.at_id) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP3 = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS a FROM documents),
ix AS (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM w WHERE len(a) > 4),
wi AS (SELECT doc_id, i, array_to_string(a[i:i + 4], ' ') AS g FROM ix),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM wi) WHERE k > 1),
rp AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM tw) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, CAST(len(a) AS BIGINT) AS n, CAST(length(array_to_string(a, '')) AS BIGINT) AS chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS sym,
 length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS up, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ln, coalesce(rp.rep, 0) AS rep FROM w LEFT JOIN rp ON rp.doc_id = w.doc_id),
d AS (SELECT *, CAST(len(ln) AS BIGINT) AS nl, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS dup FROM s),
v AS (SELECT *, CASE WHEN n > 0 THEN sym * 1000 // n END AS v1, CASE WHEN nl > 0 THEN dup * 1000 // nl END AS v2, CASE WHEN n > 0 THEN up * 1000 // chars END AS v3, CASE WHEN n > 0 THEN chars * 10 // n END AS v4 FROM d),
u AS (SELECT lang, source, 1 AS k, v1 AS x FROM v UNION ALL SELECT lang, source, 2, v2 FROM v UNION ALL SELECT lang, source, 3, v3 FROM v UNION ALL SELECT lang, source, 4, v4 FROM v),
h AS (SELECT lang, source, k, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b, count(*) AS c FROM u WHERE x IS NOT NULL GROUP BY ALL),
h2 AS (SELECT lang, k, b, sum(c) AS c FROM h GROUP BY ALL),
t2 AS (SELECT lang, k, b, c, sum(c) OVER (PARTITION BY lang, k) AS total FROM h2),
sl AS (SELECT * FROM (VALUES (1, 200), (2, 450), (3, 300), (4, 60)) x(k, slack)),
bl AS (SELECT p.lang, p.source, p.k, t2.b, CAST(coalesce(h.c, 0) AS HUGEINT) * t2.total + 50 * t2.c AS w FROM (SELECT DISTINCT lang, source, k FROM h) p JOIN t2 ON t2.k = p.k AND t2.lang IS NOT DISTINCT FROM p.lang
 LEFT JOIN h ON h.k = p.k AND h.b = t2.b AND h.lang IS NOT DISTINCT FROM p.lang AND h.source IS NOT DISTINCT FROM p.source),
f1 AS (SELECT lang, source, k, b, sum(w) OVER (PARTITION BY lang, source, k ORDER BY b) AS upto, sum(w) OVER (PARTITION BY lang, source, k) AS total FROM bl),
g1 AS (SELECT lang, source, k, min(b) FILTER (upto * 100 >= total * 50) AS mid, min(b) FILTER (upto * 100 >= total * 10) AS low FROM f1 GROUP BY ALL),
lim AS (SELECT g1.lang, g1.source, g1.k, g1.mid + greatest(slack, 8 * (g1.mid - g1.low)) AS top FROM g1 JOIN sl ON sl.k = g1.k),
wide AS (SELECT lang, source, max(top) FILTER (k = 1) AS m1, max(top) FILTER (k = 2) AS m2, max(top) FILTER (k = 3) AS m3, max(top) FILTER (k = 4) AS m4 FROM lim GROUP BY ALL)
SELECT doc_id, n AS n_words, chars AS word_chars, sym AS n_symbols, dup AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, n < 10 OR rep * 100 > n * 20 AS base_failed,
 NOT (n < 10 OR rep * 100 > n * 20) AND NOT (coalesce(v1 > m1, false) OR coalesce(v2 > m2, false) OR coalesce(v3 > m3, false) OR coalesce(v4 > m4, false)) AS kept
FROM v LEFT JOIN wide ON v.lang IS NOT DISTINCT FROM wide.lang AND v.source IS NOT DISTINCT FROM wide.source"""


def _nearest(entries: str) -> str:
    """Of each part its nearest entry, and its squared distance times 64 plus that entry."""
    return f"""SELECT p.r, p.part, any_value(p.x) AS x, min(64 * list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e.entry) AS m
 FROM p JOIN {entries} e ON e.part = p.part GROUP BY p.r, p.part"""


def _moved(entries: str, assigned: str) -> str:
    return f"""SELECT e.part, e.entry, coalesce(n.x, e.x) AS x FROM {entries} e LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS x FROM
 (SELECT part, entry, j, sum(v) AS s, count(*) AS c FROM (SELECT part, m % 64 AS entry, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM {assigned}) GROUP BY part, entry, j)
 GROUP BY part, entry) n ON n.part = e.part AND n.entry = e.entry"""


OP11 = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT len(v) AS n FROM k WHERE len(v) > 0 AND len(v) % 16 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
o AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM k JOIN n ON len(v) = n),
p AS (SELECT r, part, list_slice(v, part * len(v) // 16 + 1, (part + 1) * len(v) // 16) AS x FROM o CROSS JOIN range(16) t(part)),
e0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
a0 AS ({_nearest("e0")}),
e1 AS ({_moved("e0", "a0")}),
a1 AS ({_nearest("e1")}),
e2 AS ({_moved("e1", "a1")}),
a2 AS ({_nearest("e2")}),
c AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM e2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM o JOIN c ON c.r = o.r CROSS JOIN h"""

OP13 = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS a, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, t, a, CAST(len(a) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, array_to_string(list_slice(a, 1, i), '') AS p, array_to_string(list_slice(a, i + 1, j), '') AS m, array_to_string(list_slice(a, j + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
