"""The contracts of the operators as DuckDB SQL, written from their definitions: no hashing, no index, no blocking but by equality."""

from __future__ import annotations

from lodestone.llm import secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column},''),'{UPPER}','{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {words("text")} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
cls AS (SELECT s, min(doc_id) AS rep, count(*) AS n FROM sets GROUP BY s),
sh AS (SELECT rep, len(s) AS size, unnest(s) AS x FROM cls),
pr AS (SELECT a.rep AS a, b.rep AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM pr WHERE c * 100 >= 80 * (sa + sb - c)),
reach(a, b) AS (SELECT rep, rep FROM cls UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1),
cnt AS (SELECT l.a AS rep, sum(c.n) AS linked FROM links l JOIN cls c ON c.rep = l.b GROUP BY 1)
SELECT d.doc_id, coalesce(comp.class_id, d.doc_id) AS class_id, coalesce(cls.n - 1 + coalesce(cnt.linked, 0), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN cls ON cls.s = sets.s LEFT JOIN comp ON comp.rep = cls.rep LEFT JOIN cnt ON cnt.rep = cls.rep"""

REPEATS = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, octet_length(encode(coalesce(text,''))) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
isl AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM dup)),
sp AS (SELECT doc_id, k, min(i) AS s, max(i) + 100 AS e FROM isl GROUP BY 1, 2),
keep AS (SELECT doc_id, s AS e0, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS s0 FROM sp UNION ALL SELECT h.doc_id, h.n, coalesce(max(sp.e), 0) FROM h LEFT JOIN sp ON sp.doc_id = h.doc_id GROUP BY h.doc_id, h.n),
body AS (SELECT keep.doc_id, string_agg(substr(h.h, (2 * s0 + 1)::BIGINT, (2 * (e0 - s0))::BIGINT), '' ORDER BY s0) AS x FROM keep JOIN h ON h.doc_id = keep.doc_id GROUP BY 1)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce((SELECT sum(e - s) FROM sp WHERE sp.doc_id = h.doc_id), 0)::BIGINT AS n_removed, (SELECT count(*) FROM sp WHERE sp.doc_id = h.doc_id) AS n_spans, sha256(unhex(body.x)) AS kept_sha256 FROM h JOIN body ON body.doc_id = h.doc_id"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents), b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.x = dw.x),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""

LINES = r"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents),
ln AS (SELECT doc_id, no, raw, trim(raw, chr(9)||chr(11)||chr(12)||chr(13)||' ') AS x FROM raw),
first AS (SELECT x, min((doc_id, no)) AS f, length(x) AS n FROM ln WHERE x <> '' GROUP BY x),
ks AS (SELECT x, f, n, n AS family, 'p' AS side, substr(x, 1, n // 2) AS k FROM first WHERE n >= 20 UNION ALL SELECT x, f, n, n, 's', substr(x, n // 2 + 1) FROM first WHERE n >= 20
UNION ALL SELECT x, f, n, n - 1, 'p', substr(x, 1, (n - 1) // 2) FROM first WHERE n >= 20 UNION ALL SELECT x, f, n, n - 1, 's', substr(x, (n - 1) // 2 + 2) FROM first WHERE n >= 20),
cand AS (SELECT DISTINCT a.x AS a, b.x AS b, a.n AS na, b.n AS nb, a.f AS fa, b.f AS fb FROM ks a JOIN ks b ON a.family = b.family AND a.side = b.side AND a.k = b.k AND a.x <> b.x AND a.n <= b.n AND b.n - a.n <= 1),
near AS (SELECT * FROM cand WHERE list_bool_or(list_transform(range(0, na + 1), lambda i: substr(a, 1, i) = substr(b, 1, i) AND substr(a, i + 1 + CASE WHEN na = nb THEN 1 ELSE 0 END) = substr(b, i + 2)))),
bad AS (SELECT b AS x FROM near WHERE fa < fb UNION SELECT a FROM near WHERE fb < fa),
st AS (SELECT ln.doc_id, ln.no, ln.raw, ln.x, ln.x <> '' AND ((ln.doc_id, ln.no) <> first.f OR bad.x IS NOT NULL) AS gone FROM ln LEFT JOIN first ON first.x = ln.x LEFT JOIN bad ON bad.x = ln.x),
ag AS (SELECT doc_id, count(*) FILTER (x <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)) AS t FROM st GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_lines > 0 AND n_removed >= n_lines, false) AS emptied, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256 FROM documents d LEFT JOIN ag ON ag.doc_id = d.doc_id"""

WARC = """SELECT page_id, n AS payload_bytes, sha256(x) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS x, octet_length(encode(coalesce(html, '')))::BIGINT AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)"""


def _anycase(pattern: str) -> str:
    """The keywords of a pattern as classes of both cases; what stands in classes already is left alone."""
    out, inside, escaped = "", False, False
    for c in pattern:
        inside = c == "[" if not inside and not escaped and c == "[" else inside and not (c == "]" and not escaped)
        out += f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside and not escaped else c
        escaped = c == "\\" and not escaped
    return out


def _rule_sql(rule: secrets.Rule, order: int) -> str:
    pattern = rule.pattern if rule.kind != "hex" else rule.pattern.replace("+", f"{{{rule.least},}}")
    pattern = (_anycase(pattern) if rule.ignore_case else pattern).replace(r"\x20", "[ ]").replace("'", "''")
    return f"""SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, st AS s, st + length(m[i]) AS e FROM (SELECT doc_id, m, g, i, coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT AS st FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM t))) WHERE length(g[i]) >= {rule.least}"""


def secrets_sql(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    parts = " UNION ALL ".join(_rule_sql(r, k) for k, r in enumerate(rules))
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secrets.BASE)
    joined = "string_agg(kind||':'||s||':'||e, ',' ORDER BY s, k)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), sp AS ({parts})
SELECT t.doc_id, {counts}, sha256(coalesce({joined} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({joined} FILTER (kind IS NOT NULL), '') AS spans FROM t LEFT JOIN sp ON sp.doc_id = t.doc_id GROUP BY t.doc_id"""


VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), cnt AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN comp ON comp.a = e.vec_id LEFT JOIN cnt ON cnt.a = e.vec_id"""
