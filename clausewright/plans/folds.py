"""DuckDB SQL of the folds: what a row becomes depends on the rows before it, so each is a recursive query."""

from __future__ import annotations

from clausewright import rules
from clausewright.plans.sql import decided, is_boundary, quote, strip, sub

#: (doc_id, para_idx, text) of the structural splitter.
PARAGRAPHS = f"""SELECT doc_id, para_idx, string_agg(line, ' ' ORDER BY line_no) AS text FROM (
    SELECT *, (sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS para_idx FROM (
      SELECT *, (after_blank OR {is_boundary('line')})::INT AS starts FROM (
        SELECT doc_id, line_no, line, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) = '', true) AS after_blank FROM (
          SELECT doc_id, line_no, {strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM (
            SELECT doc_id, {strip(sub("replace(text, chr(9), ' ')", '[ \\f\\r\\x0B]{2,}', ' '))} AS t FROM documents) AS a) AS b) AS c) AS d WHERE line <> '') AS e) AS f GROUP BY doc_id, para_idx"""


def split_heading(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({strip(text)}, {quote(p)})" for p in (rules.BOUNDARY_NUMBERED, rules.BOUNDARY_KEYWORD, rules.BOUNDARY_CAPS)) + ")"


#: Short orphans merged: what is pending after a paragraph goes before the next; a last one joins what was done before.
ORPHANS = f"""
WITH RECURSIVE p AS MATERIALIZED ({PARAGRAPHS}), n AS (SELECT doc_id, max(para_idx) AS last FROM p GROUP BY doc_id),
f AS (
  SELECT doc_id, -1 AS i, NULL::VARCHAR AS pending, NULL::VARCHAR AS done FROM n
  UNION ALL
  SELECT doc_id, i, CASE WHEN o THEN now END, CASE WHEN NOT o THEN now END FROM (
    SELECT *, length(now) < 40 AND NOT {split_heading('now')} AS o FROM (SELECT f.doc_id, p.para_idx AS i, concat_ws(' ', f.pending, p.text) AS now FROM f JOIN p ON p.doc_id = f.doc_id AND p.para_idx = f.i + 1) AS a) AS b
),
d AS (SELECT doc_id, i, done, max(i) OVER (PARTITION BY doc_id) AS top FROM f WHERE done IS NOT NULL),
t AS (SELECT f.doc_id, f.pending FROM f JOIN n ON f.doc_id = n.doc_id AND f.i = n.last WHERE f.pending IS NOT NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS para_idx, text FROM (
  SELECT d.doc_id, i, CASE WHEN i = top AND t.pending IS NOT NULL THEN done || ' ' || t.pending ELSE done END AS text FROM d LEFT JOIN t ON d.doc_id = t.doc_id
  UNION ALL SELECT doc_id, 0, pending FROM t WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS r
"""


def chunks(source: str) -> str:
    """(doc_id, para_idx, text) of the clause map's chunks; windows of 900 characters where one long part is left."""
    parts = lambda separator: f"list_filter(list_transform(regexp_split_to_array(t, {quote(separator)}), lambda x: {strip('x')}), lambda x: length(x) > 30)"
    return rf"""
WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, t, {parts('\n{2,}')} AS blank, {parts('\n+')} AS lines FROM (SELECT doc_id, {strip('text')} AS t FROM ({source}) AS s) AS a),
c AS MATERIALIZED (SELECT doc_id, CASE WHEN len(blank) >= 2 THEN blank WHEN len(lines) >= 2 THEN lines END AS several, coalesce(blank[1], t) AS blob FROM b),
w AS (
  SELECT doc_id, blob, 0 AS i, NULL::VARCHAR AS piece, -1 AS k FROM c WHERE several IS NULL AND length(blob) > 900
  UNION ALL
  SELECT doc_id, blob, CASE WHEN cuts THEN i + cut + 1 ELSE j END, CASE WHEN cuts THEN {strip('substr(blob, i + 1, cut)')} ELSE whole END, k + 1 FROM (
    SELECT *, j < length(blob) AND contains(whole, ' ') AND cut > 450 AS cuts FROM (
      SELECT *, (length(whole) - strpos(reverse(whole), ' '))::INT AS cut FROM (SELECT *, least(i + 900, length(blob))::INT AS j, {strip('substr(blob, i + 1, least(i + 900, length(blob)) - i)')} AS whole FROM w WHERE i < length(blob)) AS x) AS y) AS z
)
SELECT doc_id, (generate_subscripts(several, 1) - 1)::INT AS para_idx, unnest(several) AS text FROM c WHERE several IS NOT NULL
UNION ALL SELECT doc_id, 0, blob FROM c WHERE several IS NULL AND length(blob) BETWEEN 31 AND 900
UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT, piece FROM w WHERE length(piece) > 30
"""


def clean_summary(text: str) -> str:
    t = sub(f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))", r"\n{3,}", "X").replace("'X'", "chr(10) || chr(10)")
    return strip(sub(sub(t, r"[ \t]+", " "), r"[^\x20-\x7E\n]", " "))


def sentences(text: str) -> str:
    """Sentences end before a capital; the engine has no look-behind, so a mark is put between and split at."""
    marked = f"regexp_replace({text}, {quote('([.!?])[ \\t\\n\\f\\r]+([A-Z])')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def overlapping(source: str, limit: int = 700) -> str:
    """(doc_id, chunk_no, chunk) of whole sentences up to `limit` words, each begun with the last words of the one before."""
    overlap = max(50, limit // 10)
    return rf"""
WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS sentence FROM (SELECT doc_id, {sentences(clean_summary('text'))} AS l FROM ({source}) AS q) AS a),
v AS MATERIALIZED (SELECT doc_id, i, regexp_extract_all(sentence, '\S+') AS own FROM s), n AS (SELECT doc_id, max(i) AS last FROM s GROUP BY doc_id),
f AS (
  SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS now, []::VARCHAR[] AS done FROM n
  UNION ALL
  SELECT f.doc_id, v.i, CASE WHEN len(own) > {limit} THEN now WHEN len(now) + len(own) > {limit} THEN list_concat(now[greatest(len(now) - {overlap - 1}, 1):], own) ELSE list_concat(now, own) END,
    CASE WHEN len(own) > {limit} THEN list_transform(range(0, len(own), {limit}), lambda k: array_to_string(own[k + 1 : k + {limit}], ' ')) WHEN len(now) + len(own) > {limit} AND len(now) > 0 THEN [array_to_string(now, ' ')] ELSE [] END
  FROM f JOIN v ON v.doc_id = f.doc_id AND v.i = f.i + 1
),
e AS (SELECT doc_id, i, generate_subscripts(done, 1) AS j, unnest(done) AS chunk FROM f UNION ALL SELECT f.doc_id, f.i + 1, 1, array_to_string(now, ' ') FROM f JOIN n ON f.doc_id = n.doc_id AND f.i = n.last WHERE len(now) > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_no, chunk FROM e
"""


def type_label(column: str) -> str:
    names = {c: rules.TYPE_LABELS.get(c, c.replace("_", " ").title()) for c in (*rules.CLAUSE_PATTERNS, "other")}
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN {quote(n)}" for c, n in names.items()) + " END"


def map_summary(source: str) -> str:
    """The groups of the clause map of (doc_id, text)."""
    return f"""SELECT doc_id, label AS clause_type, {type_label('label')} AS label, n, avg_confidence, first_idx, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_idx)::INT AS position
FROM (SELECT doc_id, label, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, min(para_idx) AS first_idx FROM ({decided(chunks(source))}) AS d GROUP BY doc_id, label) AS g"""


def summaries(source: str) -> str:
    """(doc_id, overall_summary, key_points, obligations, payment_terms, termination, risks) with lists joined by line
    ends, of (doc_id, text)."""
    count = lambda x: rf"len(regexp_extract_all({x}, '\S+'))"
    names = {"obligations": "obligations", "payment": "payment_terms", "termination": "termination", "risk": "risks"}
    tagged = ", ".join(
        f"coalesce((SELECT string_agg(x, chr(10) ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(own) AS x, generate_subscripts(own, 1) AS k FROM (SELECT list_filter(l, lambda x: regexp_matches(lower(x), {quote(p)}))[:8] AS own)) GROUP BY x)), '') AS {names[s]}"
        for s, p in rules.SECTION_PATTERNS.items()
    )
    return rf"""
WITH c AS MATERIALIZED ({overlapping(source)}),
o AS MATERIALIZED (SELECT doc_id, string_agg(CASE WHEN len(w) > 80 THEN array_to_string(w[:80], ' ') || ' …' ELSE array_to_string(w, ' ') END, ' ' ORDER BY chunk_no) AS overall_summary FROM (SELECT doc_id, chunk_no, regexp_extract_all(chunk, '\S+') AS w FROM c) AS x GROUP BY doc_id),
k AS (SELECT doc_id, overall_summary, list_filter({sentences('overall_summary')}, lambda x: {count('x')} > 6)[:8] AS points FROM o),
l AS (SELECT doc_id, list_filter({sentences(clean_summary('text'))}, lambda x: {count('x')} > 5) AS l FROM ({source}) AS q),
t AS (SELECT doc_id, {tagged} FROM l)
SELECT k.doc_id, overall_summary, CASE WHEN len(points) > 0 THEN array_to_string(points, chr(10)) ELSE overall_summary END AS key_points, obligations, payment_terms, termination, risks FROM k JOIN t ON k.doc_id = t.doc_id
"""


# Central sentences ----------------------------------------------------------------------------------------------------


def central_chunks(source: str, start: int, own: int, flows: int, rounds: int, most: int) -> str:
    """(doc_id, chunk_no, n_sentences, ranks, summary) over the overlapping chunks of a source (doc_id, text)."""
    steps = [f"r0 AS (SELECT doc_id, chunk_no, i, {start}::BIGINT AS r FROM sent)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT s.doc_id, s.chunk_no, s.i, ({own} + coalesce(sum({flows} * r * w // d), 0))::BIGINT AS r FROM sent AS s LEFT JOIN edge AS e ON s.doc_id = e.doc_id AND s.chunk_no = e.chunk_no AND s.i = e.i LEFT JOIN r{k} AS r ON e.doc_id = r.doc_id AND e.chunk_no = r.chunk_no AND e.j = r.i GROUP BY ALL)")
    return rf"""WITH ck AS MATERIALIZED ({overlapping(source)}),
sent AS MATERIALIZED (SELECT doc_id, chunk_no, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, chunk_no, {sentences('chunk')} AS l FROM ck) AS a),
wd AS MATERIALIZED (SELECT DISTINCT doc_id, chunk_no, i, w FROM (SELECT doc_id, chunk_no, i, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM sent) AS a),
size AS MATERIALIZED (SELECT doc_id, chunk_no, i, count(*) AS n FROM wd GROUP BY ALL),
pair AS MATERIALIZED (SELECT a.doc_id, a.chunk_no, a.i, b.i AS j, count(*) AS c FROM wd AS a JOIN wd AS b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.w = b.w AND a.i <> b.i GROUP BY ALL),
wide AS MATERIALIZED (SELECT b.*, 1000 * c // (x.n + y.n) AS w, least(x.n, y.n) AS least_n FROM pair AS b JOIN size AS x ON b.doc_id = x.doc_id AND b.chunk_no = x.chunk_no AND b.i = x.i JOIN size AS y ON b.doc_id = y.doc_id AND b.chunk_no = y.chunk_no AND b.j = y.i),
edge AS MATERIALIZED (SELECT *, greatest(1000 * sum(w) OVER (PARTITION BY doc_id, chunk_no, j), 1)::BIGINT AS d FROM wide),
{', '.join(steps)},
ranked AS MATERIALIZED (SELECT s.*, r.r, z.n, row_number() OVER (PARTITION BY s.doc_id, s.chunk_no ORDER BY r.r DESC, s.i) AS place FROM sent AS s JOIN r{rounds} AS r ON s.doc_id = r.doc_id AND s.chunk_no = r.chunk_no AND s.i = r.i LEFT JOIN size AS z ON s.doc_id = z.doc_id AND s.chunk_no = z.chunk_no AND s.i = z.i),
bad AS (SELECT DISTINCT e.doc_id, e.chunk_no, e.i FROM edge AS e JOIN ranked AS x ON e.doc_id = x.doc_id AND e.chunk_no = x.chunk_no AND e.i = x.i JOIN ranked AS y ON e.doc_id = y.doc_id AND e.chunk_no = y.chunk_no AND e.j = y.i WHERE y.place < x.place AND 2 * c >= least_n),
good AS (SELECT *, sum(len(regexp_extract_all(s, '\S+'))) OVER (PARTITION BY doc_id, chunk_no ORDER BY place) AS total, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY place) AS first FROM ranked AS r ANTI JOIN bad AS b ON r.doc_id = b.doc_id AND r.chunk_no = b.chunk_no AND r.i = b.i WHERE n IS NOT NULL),
said AS (SELECT doc_id, chunk_no, string_agg(s, ' ' ORDER BY i) AS summary FROM good WHERE total <= {most} OR first = 1 GROUP BY ALL),
told AS (SELECT doc_id, chunk_no, count(*)::INT AS n_sentences, string_agg(r::VARCHAR, ',' ORDER BY i) AS ranks FROM ranked GROUP BY ALL)
SELECT c.doc_id, c.chunk_no, coalesce(n_sentences, 0) AS n_sentences, coalesce(ranks, '') AS ranks, coalesce(summary, '') AS summary FROM ck AS c LEFT JOIN told AS t ON c.doc_id = t.doc_id AND c.chunk_no = t.chunk_no LEFT JOIN said AS s ON c.doc_id = s.doc_id AND c.chunk_no = s.chunk_no"""


# Trained sentence boundaries ------------------------------------------------------------------------------------------


def sentence_parts(source: str) -> str:
    """CTEs tok, words, totals, abbr, pairs, coll, starters over a source (doc_id, text), as operators/sentences.py has
    them: every token with its word, how it ends and begins, and its neighbours."""
    ratio = lambda k, n1, n2, n: "2 * (" + " + ".join(f"{sign}({_part(a, p)} + {_part(f'({b}) - ({a})', f'1 - ({p})')})" for sign, a, b, p in (("", k, n1, f"({k})::DOUBLE / ({n1})"), ("", f"({n2}) - ({k})", f"({n}) - ({n1})", f"CASE WHEN ({n}) = ({n1}) THEN 0 ELSE (({n2}) - ({k}))::DOUBLE / (({n}) - ({n1})) END"), ("-1 * ", k, n1, f"({n2})::DOUBLE / ({n})"), ("-1 * ", f"({n2}) - ({k})", f"({n}) - ({n1})", f"({n2})::DOUBLE / ({n})"))) + ")"
    return rf"""
raw AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS place FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r]+[ \t\n\f\r]*') AS l FROM ({source}) AS s) AS a),
core AS (SELECT *, regexp_replace(regexp_replace(token, '[ \t\n\f\r]+$', ''), '^["''(\[{{]+|["'')\]}}]+$', '', 'g') AS c FROM raw),
word AS (SELECT doc_id, place, token, c, lower(regexp_replace(c, '[.,;:!?]+$', '')) AS w FROM core),
tok AS MATERIALIZED (SELECT *, lead(word) OVER o AS next, lead(upper) OVER o AS next_upper, lead(low) OVER o AS next_low, coalesce(lag(ends) OVER o, false) AS after_end FROM (
  SELECT doc_id, place, token, CASE WHEN regexp_matches(w, '^[0-9][0-9.,/-]*$') THEN '##' ELSE w END AS word, regexp_matches(c, '[^.!?]\.$') AS stop, regexp_matches(c, '[.!?]$') AS ends, regexp_matches(c, '[!?]$') AS loud, regexp_matches(c, '^\p{{Lu}}') AS upper, regexp_matches(c, '^\p{{Ll}}') AS low FROM word) AS b WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
words AS MATERIALIZED (SELECT word, count(*) AS n, count(*) FILTER (stop) AS stops, count(*) FILTER (low) AS lowers, count(*) FILTER (upper AND NOT after_end AND place > 0) AS uppers FROM tok WHERE word <> '' GROUP BY word),
totals AS (SELECT sum(n)::DOUBLE AS n, sum(stops)::DOUBLE / sum(n) AS p FROM words),
abbr AS MATERIALIZED (SELECT * FROM (SELECT word, stops, 2 * (stops * ln(0.99::DOUBLE / p) + CASE WHEN w.n > stops THEN (w.n - stops) * ln(0.01::DOUBLE / (1 - p)) ELSE 0 END) * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', ''))::DOUBLE, -(w.n - stops)) AS score
  FROM words AS w CROSS JOIN totals AS t WHERE stops > 0 AND regexp_matches(word, '\p{{L}}')) AS a WHERE score >= 0.3),
pairs AS MATERIALIZED (SELECT word, next, count(*) AS k FROM tok WHERE stop AND next <> '' AND word <> '' GROUP BY word, next),
coll AS MATERIALIZED (SELECT word, next FROM (SELECT p.word, p.next, k, a.stops, w.n AS n2, t.n FROM pairs AS p JOIN abbr AS a ON p.word = a.word JOIN words AS w ON p.next = w.word CROSS JOIN totals AS t WHERE regexp_matches(p.next, '\p{{L}}')) AS c WHERE {ratio('k', 'stops', 'n2', 'n')} >= 7.88 AND k * n > stops * n2),
sure AS MATERIALIZED (SELECT next, sum(k)::BIGINT AS k FROM pairs WHERE regexp_matches(word, '\p{{L}}') AND NOT regexp_matches(word, '^\p{{L}}$') AND word NOT IN (SELECT word FROM abbr) GROUP BY next),
starters AS MATERIALIZED (SELECT next AS word FROM (SELECT s.next, s.k, b.k AS breaks, w.n AS n2, t.n FROM sure AS s JOIN words AS w ON s.next = w.word CROSS JOIN totals AS t CROSS JOIN (SELECT sum(k)::BIGINT AS k FROM sure) AS b WHERE regexp_matches(s.next, '\p{{L}}')) AS c WHERE {ratio('k', 'breaks', 'n2', 'n')} >= 30 AND k * n > breaks * n2)"""


def _part(count: str, share: str) -> str:
    return f"CASE WHEN ({count}) > 0 THEN ({count}) * ln({share}) ELSE 0 END"


def trained_sentences(source: str) -> str:
    """(doc_id, place, token, last): whether a sentence ends with the token."""
    return rf"""WITH {sentence_parts(source)}
SELECT t.doc_id, t.place, t.token, CASE WHEN t.next IS NULL OR loud THEN true WHEN NOT stop THEN ends AND next_upper
  WHEN t.word = '##' THEN NOT next_low
  WHEN (a.word IS NOT NULL AND regexp_matches(t.word, '\p{{L}}')) OR regexp_matches(t.word, '^\p{{L}}$') THEN c.word IS NULL AND next_upper AND (s.word IS NOT NULL OR coalesce(n.lowers > 0 AND n.uppers = 0, false)) ELSE true END AS last
FROM tok AS t LEFT JOIN abbr AS a ON t.word = a.word LEFT JOIN coll AS c ON t.word = c.word AND t.next = c.next LEFT JOIN starters AS s ON t.next = s.word LEFT JOIN words AS n ON t.next = n.word"""
