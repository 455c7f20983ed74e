"""The queries that SQL can express, in SQL."""

from .oracle_vectors import OP11

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP9 = f"""WITH b AS (SELECT item_id, w, len(w) AS n, least(len(w), 10) AS L FROM (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, L, array_to_string(w[i:i + L - 1], ' ') AS g FROM b, unnest(range(1, n - L + 2)) t(i)),
d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents)),
sizes AS (SELECT DISTINCT L FROM win),
spots AS (SELECT doc_id, L, i, array_to_string(w[i:i + L - 1], ' ') AS g FROM (SELECT d.*, L FROM d, sizes WHERE n >= L) x, unnest(range(1, n - L + 2)) t(i)),
hit AS (SELECT doc_id, i, L, item_id FROM spots JOIN win USING (L, g)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, L)) t(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _windows(size: int) -> str:
    return f"""d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {size - 2})) t(i))"""


OP10 = f"""WITH {_windows(13)}, lows AS (SELECT g, min(doc_id) AS low FROM win GROUP BY 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS p FROM win JOIN lows USING (g), unnest(range(0, 13)) t(k) WHERE doc_id > low GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""

OP2 = f"""WITH {_windows(50)}, places AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r, count(*) OVER (PARTITION BY g) AS n FROM win),
pos AS (SELECT doc_id, i + k AS p, max(r) AS r FROM places, unnest(range(0, 50)) t(k) WHERE n > 1 GROUP BY 1, 2),
runs AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM pos WHERE r > 1),
spans AS (SELECT doc_id, string_agg((low - 1) || '-' || high, ',' ORDER BY low) AS removed FROM (SELECT doc_id, min(p) AS low, max(p) AS high FROM runs GROUP BY doc_id, run) GROUP BY 1),
sums AS (SELECT doc_id, count(*) AS n_repeated, count(CASE WHEN r > 1 THEN 1 END) AS n_removed FROM pos GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN spans USING (doc_id)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, c FROM reach JOIN links ON a = doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) c USING (doc_id)"""

OP4 = r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
 list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS args FROM p),
c AS (SELECT *, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical_url, '"' || md5(body) || '"' AS tag FROM q),
again AS (SELECT page_id * 2 + 1 AS record_id, url, canonical_url, page_id * 10 + 5 + page_id % 7 * 10 AS time, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE tag END AS tag FROM c),
m AS (SELECT a.*, f.page_id, f.tag AS own, f.html, f.body FROM again a ASOF LEFT JOIN (SELECT *, page_id * 10 AS t FROM c) f ON a.canonical_url = f.canonical_url AND a.time > f.t)
SELECT record_id, url, canonical_url, time, CASE WHEN page_id IS NULL THEN 'missing' WHEN tag = own THEN 'resolved' ELSE 'mismatch' END AS state, page_id * 2 AS source_id,
'cache-control: max-age=60' || chr(10) || CASE WHEN tag = own THEN 'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' ELSE 'content-length: 0' END || chr(10) || 'date: ' || time || chr(10) || 'etag: W/' || tag AS headers,
CASE WHEN tag = own THEN sha256(html) END AS payload_sha256 FROM m"""

OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
f AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, k, count(*) AS f FROM p, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) t(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, g, k, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.g, a, x.f AS l, y.f AS r, j, (CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS s FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[j + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY s, j) = 1),
longer AS (SELECT lang, array_to_string(w[o:o + k - 2], ' ') AS g, max(a) AS b FROM c, unnest([1, 2]) t(o) WHERE k = 3 GROUP BY 1, 2),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, g) AS rank, g AS phrase, a, l, r, s FROM low LEFT JOIN longer USING (lang, g) WHERE b IS NULL OR 100 * b < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(s AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

SQL = {"op2_suffix_array": OP2, "op4_revisits": OP4, "op5_lsh_forest": OP5, "op9_winnowing": OP9, "op10_recompression": OP10, "op11_delta_lloyd": OP11, "op13_collocations": OP13}
