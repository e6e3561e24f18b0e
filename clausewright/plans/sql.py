"""Pieces of DuckDB SQL that mirror column functions, for the queries' oracles."""

from __future__ import annotations

from clausewright import rules
from clausewright.corpus import CORPUS_SQL


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quote('(?i)' + pattern)}))"


def scores(source: str, keys: str = "doc_id, para_idx, text") -> str:
    """Counts per class, as clause_scores()."""
    columns = ", ".join(f"({' + '.join(hits('text', p) for p in ps)})::INT AS score_{c}" for c, ps in rules.CLAUSE_PATTERNS.items())
    return f"SELECT {keys}, {columns} FROM ({source}) AS s"


def decided(source: str, keys: str = "doc_id, para_idx, text") -> str:
    """label and confidence, as decided(); keeps the scores, best_score and total_score."""
    names = [f"score_{c}" for c in rules.CLAUSE_PATTERNS]
    cases = " ".join(f"WHEN score_{c} = best_score THEN '{c}'" for c in rules.CLAUSE_PATTERNS)
    return f"""
SELECT *, CASE WHEN total_score = 0 THEN 'other' {cases} END AS label,
  CASE WHEN total_score > 0 THEN round(best_score::DOUBLE / total_score, 4) ELSE 0.0 END AS confidence
FROM (SELECT *, greatest({', '.join(names)}) AS best_score, {' + '.join(names)} AS total_score FROM ({scores(source, keys)}) AS a) AS b
"""


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"


def words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def clean_paragraph(text: str) -> str:
    t = sub(f"replace({text}, chr(10), ' ')", r"\s+([.,;:)])", r"\1")
    t = sub(t, r"([.,;:)])([A-Za-z0-9])", r"\1 \2")
    t = sub(t, r"([(])\s+", r"\1")
    return strip(sub(sub(t, r"\s+([)])", r"\1"), " +", " "))


def clean_ocr(text: str) -> str:
    t = sub(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{7F}-\\x{9F}]", "")
    for wrong, right in ((r"\|", "I"), ("0", "O"), ("§", "S"), ("¢", "c"), ("©", "(c)")):
        t = sub(t, f"([a-zA-Z]){wrong}([a-zA-Z])", rf"\1{right}\2")
    t = sub(sub(t, " +", " "), r"\t+", " ")
    t = f"array_to_string(list_filter(string_split({t}, chr(10)), lambda x: len(regexp_extract_all(x, '[a-zA-Z0-9]')) >= 3), chr(10))"
    t = f"regexp_replace({t}, '\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    t = sub(t, r"(?m)^[\s\-]*(?:Page\s*)?\d+[\s\-]*$", "")
    t = sub(sub(t, "-{3,}", ""), r"\.{4,}", "...")
    return strip(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), chr(10))")


def is_heading(text: str) -> str:
    t = strip(text)
    numbered = "(?i)" + "|".join(f"(?:{p})" for p in rules.HEADING_NUMBERING)
    keyword = "|".join(rules.HEADING_KEYWORDS)
    capitals, letters = rf"len(regexp_extract_all({t}, '\p{{Lu}}'))", rf"len(regexp_extract_all({t}, '\p{{L}}'))"
    return f"(length({text}) > 0 AND {words(t)} <= 12 AND (regexp_matches({t}, {quote(numbered)}) OR {capitals} > {letters} * 0.7 OR (regexp_matches(upper({t}), {quote(keyword)}) AND length({t}) < 100)))"


def is_boundary(line: str) -> str:
    return " OR ".join(f"regexp_matches({line}, {quote(p)})" for p in (rules.BOUNDARY_NUMBERED, rules.BOUNDARY_KEYWORD, rules.BOUNDARY_BULLET, rules.BOUNDARY_CAPS))


def is_clause_start(text: str) -> str:
    first = rf"array_to_string(regexp_extract_all({text}, '\S+')[1:3], ' ')"
    patterns = (r"^\d+(\.\d+)*\.?\s+", r"(?i)^\([a-z0-9]+\)\s+", r"^[IVX]+\.?\s+", r"(?i)^(ARTICLE|SECTION|CLAUSE|SCHEDULE|APPENDIX|EXHIBIT)\s+")
    capitals = f"({words(text)} >= 3 AND upper({first}) = {first} AND lower({first}) <> {first} AND length({first}) > 10)"
    return "(" + " OR ".join([*(f"regexp_matches({text}, {quote(p)})" for p in patterns), capitals]) + ")"


def first_match(text: str, entries, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quote('(?i)' + p)}) THEN {quote(k)}" for k, p in entries) + f" ELSE {otherwise} END"


def risk_rules() -> str:
    rows = [f"({i}, {quote(c)}, {quote(s)}, {j}, {quote(k)})" for i, (c, s, ks) in enumerate(rules.RISK_RULES) for j, k in enumerate(ks)]
    return f"(VALUES {', '.join(rows)}) AS rules(rule_ord, category, base, kw_ord, keyword)"


def risk_matches(source: str = CORPUS_SQL) -> str:
    """(doc_id, para_idx, rule_ord, category, severity, matched_phrase, hits)."""
    return rf"""
SELECT doc_id, para_idx, rule_ord, any_value(category) AS category, arg_min(keyword, kw_ord) AS matched_phrase, count(*)::INT AS hits,
  CASE WHEN count(*) >= 2 THEN CASE any_value(base) WHEN 'LOW' THEN 'MEDIUM' ELSE 'HIGH' END ELSE any_value(base) END AS severity
FROM (SELECT * FROM (SELECT doc_id, para_idx, {strip(sub('lower(text)', r'\s+', ' '))} AS norm FROM ({source}) AS c) AS n
      WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY para_idx) = 1) AS p
JOIN {risk_rules()} ON contains(norm, keyword) GROUP BY doc_id, para_idx, rule_ord
"""


WEIGHT = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
