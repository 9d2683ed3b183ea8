"""DuckDB SQL for the queries that SQL can express, by plain definitions."""

from __future__ import annotations

from .quality_rules import ALPHA, BANDS, DELTA, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_cells = ", ".join(f"('{r}', {c}::DOUBLE)" for r, cs in RULES.items() for c in cs)
_score = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
_pairs = len(RULES) * (len(BANDS) + 1)

OP1 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(5) x(j) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS alls, count(DISTINCT l) AS kinds FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(alls - kinds, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(alls, 0) AS alls FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (CASE {" ".join(f"WHEN n_words < {b} THEN {i}" for i, b in enumerate(BANDS))} ELSE {len(BANDS)} END)::INTEGER AS stratum,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols * 100.0::DOUBLE / word_chars END AS symbol_pct, CASE WHEN alls = 0 THEN 0 ELSE n_dup_lines * 100.0::DOUBLE / alls END AS dup_line_pct,
  CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 100.0::DOUBLE / n_words END AS repeat_pct FROM b),
held AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
cells(rule, cutoff) AS (VALUES {_cells}),
loss AS (SELECT stratum, rule, cutoff, count(*) AS n, count_if({_score} > cutoff)::BIGINT AS k FROM held, cells GROUP BY 1, 2, 3),
tail AS (SELECT stratum, rule, cutoff, CASE WHEN k >= n * {ALPHA}::DOUBLE THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}::DOUBLE) + (n - j) * ln(1 - {ALPHA}::DOUBLE))) FROM range(k::BIGINT + 1) x(j)) END AS p FROM loss),
seq AS (SELECT stratum, rule, cutoff, min(CASE WHEN p <= {DELTA / _pairs!r} THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM tail),
cut AS (SELECT stratum, {", ".join(f"min(CASE WHEN rule = '{r}' THEN cutoff END) AS {r}_cutoff" for r in RULES)} FROM seq WHERE ok = 1 GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} > {r}_cutoff, false)" for r in RULES)}) AS kept,
  stratum, {", ".join(RULES)}, {", ".join(f"{r}_cutoff" for r in RULES)} FROM s LEFT JOIN cut USING (stratum)"""

OP2 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(url, '') AS u FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS query FROM p),
k AS (SELECT *, lower(array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url_key, captured, (row_number() OVER (ORDER BY url_key, captured, page_id) - 1)::BIGINT AS history_place FROM k"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({SMALL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(d, m) AS (SELECT a, b FROM g UNION SELECT r.d, g.b FROM r JOIN g ON r.m = g.a),
l AS (SELECT d, min(m) AS m FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(l.m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.d = w.doc_id"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS g FROM rep, range(35) x(j) GROUP BY 1),
word AS (SELECT w.doc_id, p, ws[p] AS x, list_contains(coalesce(g, []), p) AS out FROM w LEFT JOIN gone USING (doc_id), unnest(range(1, len(ws) + 1)) r(p) WHERE g IS NOT NULL),
kept AS (SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT out), '') AS t, count_if(out) AS n FROM word GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, array_to_string(ws, ' '))) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 6 + length(role) + 8 + length(text) + CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR regexp_matches(text, '\\[shl]') THEN length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) ELSE 0 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op2_warc": OP2, "op5_near_dedup": OP5, "op7_substring_dedup": OP7, "op10_chat_format": OP10}
