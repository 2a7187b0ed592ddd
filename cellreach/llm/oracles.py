"""DuckDB SQL for the opN queries."""

from __future__ import annotations

from cellreach.llm import quality_rules as q

_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

OP9 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tw, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
ln AS (SELECT DISTINCT doc_id, source, unnest(string_split(
         translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {_BLANKS}, 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line FROM d),
often AS (SELECT source, line, min(doc_id) AS first FROM ln WHERE line <> ''
          GROUP BY ALL HAVING count(*) > {q.MAX_DOCS_PER_LINE}),
lost AS (SELECT doc_id, sum(length(ln.line)) AS chars, count(*) AS n FROM ln JOIN often o
         ON ln.line = o.line AND ln.source IS NOT DISTINCT FROM o.source AND doc_id <> first GROUP BY doc_id),
sig AS (SELECT d.doc_id, len(ws) AS n_words,
               length(array_to_string(ws, '')) AS word_chars,
               length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
               coalesce(lost.n, 0) AS n_lost, coalesce(lost.chars, 0) AS gone,
               coalesce(a.chars, 0) AS chars
        FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
        LEFT JOIN lost USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(length(line)) AS chars FROM ln GROUP BY doc_id) a USING (doc_id)),
v AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM sig)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * (chars - gone) < {q.MIN_LEFT_PERCENT} * chars) AS kept,
       CAST(n_lost AS BIGINT) AS n_boilerplate_lines
FROM v
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""

_ALNUM = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_FOLDED)} AS ws FROM documents),
i AS (SELECT item_id, {_ALNUM.format(_FOLDED)} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + 9], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.l, '')) AS items_sha256,
       coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP5 = f"""
WITH l AS (SELECT doc_id, k - 1 AS line_no, regexp_extract_all({_FOLDED.replace("coalesce(text, '')", "ls[k]")}, '[^\\x20\\x09-\\x0D]+') AS ws
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
t AS (SELECT DISTINCT doc_id, line_no, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, line_no, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM l WHERE len(ws) > 0)),
n AS (SELECT doc_id, line_no, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT x.doc_id AS xd, x.line_no AS xl, y.doc_id AS yd, y.line_no AS yl, count(*) AS c
      FROM t x JOIN t y ON x.g = y.g AND (x.doc_id, x.line_no) > (y.doc_id, y.line_no) GROUP BY ALL),
gone AS (SELECT DISTINCT xd, xl FROM p JOIN n a ON a.doc_id = xd AND a.line_no = xl
         JOIN n b ON b.doc_id = yd AND b.line_no = yl WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT xd AS doc_id, count(*) AS n, string_agg(CAST(xl AS VARCHAR), ',' ORDER BY xl) AS s FROM gone GROUP BY xd)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.s, '') AS removed_lines
FROM documents d LEFT JOIN r USING (doc_id)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    from cellreach.llm.url_filter import PATTERN_RULES, SITE_RULES

    sites = ", ".join(
        f"('{a}', '{r}', '{r.partition('/')[0]}', '{r[len(r.partition('/')[0]):]}')" for a, r in SITE_RULES
    )
    patterns = ", ".join(f"('{a}', '{p}')" for a, p in PATTERN_RULES)
    return f"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, {_HOST} AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s(action, rule, h, pre) AS (VALUES {sites}),
q(action, rx) AS (VALUES {patterns}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
         FROM p JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id),
found AS (SELECT page_id, arg_max(rx, (length(rx), action)) AS rx, arg_max(action, (length(rx), action)) AS action
          FROM p JOIN q ON regexp_matches(u, rx) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(best.action, found.action, 'allow') AS verdict, rx AS pattern
FROM p LEFT JOIN best USING (page_id) LEFT JOIN found USING (page_id)
"""


OP1 = _op1()

_QUINTET = (
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', hx[(5 * i) // 4 + 1]) - 1) * 16"
    " + coalesce(nullif(strpos('0123456789abcdef', hx[(5 * i) // 4 + 2]), 0) - 1, 0)) >> (3 - (5 * i) % 4)) % 32, 1)"
)

OP2 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) || '00' AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, string_split(h, '') AS hx FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: {_QUINTET}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE r > 1),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
sp AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, island),
seg AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM sp
        UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN sp USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p, q) AS k FROM seg JOIN d USING (doc_id) GROUP BY doc_id),
cnt AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""
