"""DuckDB SQL for the queries that SQL can express, from their contracts and not from the operators' ways."""

from __future__ import annotations

from clausewright.llm.decontaminate import WINDOW
from clausewright.llm.infill import INFILL_SQL
from clausewright.llm.mixing import MIX_SQL
from clausewright.llm.phrases import PHRASES_SQL
from clausewright.llm.repeats import LENGTH
from clausewright.llm.secrets import BASE_KINDS, RULES, Rule

#: Names of an assigned secret, whatever their case, as another engine writes them.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(number: int, rule: Rule) -> str:
    """(doc_id, k, kind, start, stop) of one rule: the pieces between its matches tell where each begins."""
    pattern = quote(_ASSIGN if rule.kind == "assign" else rule.body)
    secret = f"regexp_extract_all(text, {pattern}, {1 if rule.kind == 'assign' else 0})"
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, start, start + length(m[i]) AS stop FROM (
      SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, {secret} AS s, string_split_regex(text, {pattern}) AS p FROM t WHERE regexp_matches(text, {pattern})) AS a) AS b
    ) AS c WHERE length(s[i]) >= {rule.least}"""


_SPANS = " UNION ALL ".join(_rule(k, r) for k, r in enumerate(RULES))
_BASE = ", ".join(f"'{k}'" for k in BASE_KINDS)
SECRETS_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS MATERIALIZED ({_SPANS}),
g AS (SELECT doc_id, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) AS spans, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) FILTER (kind IN ({_BASE})) AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)} FROM f GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""

#: Bytes as pairs of hexadecimal digits; a window is known by its md5.
REPEATS_SQL = f"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p FROM h) AS a),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) AS b WHERE n > 1),
s AS MATERIALIZED (SELECT doc_id, min(p) AS low, max(p) + {LENGTH} AS high FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r) AS c) AS d GROUP BY doc_id, g),
e AS (SELECT s.doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY s.doc_id ORDER BY low), 0) AS before, max(high) OVER (PARTITION BY s.doc_id) AS last FROM s),
k AS (SELECT e.doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * any_value(last) + 1) AS kept FROM e JOIN h ON e.doc_id = h.doc_id GROUP BY e.doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN k ON h.doc_id = k.doc_id
"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEAKS_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, {_WORD}) AS l, string_split_regex(t, {_WORD}) AS p FROM (SELECT doc_id, {_LOWER} AS t FROM documents) AS a),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, {_WORD}) AS l FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item, least(len(l), {WINDOW}) AS n, array_to_string(l[x : x + {WINDOW - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(l) - {WINDOW - 1}, 1) + 1)) AS x FROM b WHERE len(l) > 0) AS a),
g AS (SELECT doc_id, x, z.n, array_to_string(l[x : x + z.n - 1], ' ') AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS x FROM d) AS a JOIN (SELECT DISTINCT n FROM i) AS z ON x + z.n - 1 <= len(l)),
m AS MATERIALIZED (SELECT doc_id, x, g.n, item FROM g JOIN i ON g.n = i.n AND g.gram = i.gram),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(x, x + n)) AS w FROM m),
o AS (SELECT doc_id, w, start, start + size AS stop FROM (SELECT doc_id, w, size, sum(gap) OVER q + sum(size) OVER q - size AS start FROM (SELECT doc_id, generate_subscripts(l, 1) AS w, length(unnest(l)) AS size, length(unnest(p[1:len(l)])) AS gap FROM d WHERE doc_id IN (SELECT doc_id FROM c)) AS a WINDOW q AS (PARTITION BY doc_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS b),
r AS (SELECT doc_id, min(start)::BIGINT AS low, max(stop)::BIGINT AS high FROM (SELECT c.doc_id, start, stop, c.w - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.w) AS run FROM c JOIN o ON c.doc_id = o.doc_id AND c.w = o.w) AS a GROUP BY doc_id, run)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hits, '') AS hits
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n_hit FROM c GROUP BY doc_id) AS h ON d.doc_id = h.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id) AS j ON d.doc_id = j.doc_id
LEFT JOIN (SELECT doc_id, string_agg(low || ':' || high, ',' ORDER BY low) AS hits FROM r GROUP BY doc_id) AS s ON d.doc_id = s.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_secret_scans": SECRETS_SQL, "op2_suffix_array_dedup": REPEATS_SQL, "op9_benchmark_decontamination": LEAKS_SQL, "op10_source_mixing": MIX_SQL, "op12_phrase_collocations": PHRASES_SQL, "op13_fill_in_middle": INFILL_SQL}
