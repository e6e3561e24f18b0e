"""Text cleaning and predicates as column functions (all JVM expressions but nfkd_ascii)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausewright import rules

#: What Python's str.strip() and \s take for white space, as a Java class. Java asks the parts of a class one by one: the
#: first of an intersection rules out most characters at once, here and below.
SPACE = r"[[^!-~]&&[\s\x1c-\x1f\x85\xa0  -     　]]"
#: The same with the space itself first, and what is no white space, printable ASCII first: what is met most is told first.
GAP, SOLID = f"[ {SPACE}]", f"[!-~[^{SPACE[len('[[^!-~]&&['):-2]}]]"
#: The same as a set of characters, for trims: a regular expression would try its end at every run of them.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROLS = r"[[^ -~]&&[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]]"


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def strip_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), strip), "\n")


def words(text: Column) -> Column:
    """Non-empty runs between white space. A split would compile its pattern for each text."""
    return F.regexp_extract_all(text, F.lit(f"{SOLID}+"), F.lit(0))


def word_total(text: Column) -> Column:
    return F.size(words(text))


def clean_words(text: Column) -> Column:
    """words() of what clean_summary() leaves, where white space is spaces and line ends: a split at one character needs
    no regular expression."""
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), F.lit(""))


def clean_extracted(text: Column) -> Column:
    """G1: runs of spaces to one, blank lines to one, lines stripped, controls dropped, stripped."""
    t = sub(F.replace(text, F.lit("\x00"), F.lit("")), " +", " ")
    return strip(sub(strip_lines(sub(t, rf"\n{SPACE}*\n+", "\n\n")), CONTROLS, ""))


def clean_ocr(text: Column) -> Column:
    """The same for recognised text, with character fixes between letters and noise lines dropped. Lines of fewer
    than three letters or digits go, blank ones too; blanks remain only where a page-number line is emptied later."""
    t = sub(text, CONTROLS, "")
    for wrong, right in ((r"\|", "I"), ("0", "O"), ("§", "S"), ("¢", "c"), ("©", "(c)")):
        t = sub(t, f"([a-zA-Z]){wrong}([a-zA-Z])", f"$1{right}$2")
    t = sub(sub(t, " +", " "), r"\t+", " ")
    t = F.array_join(F.filter(F.split(t, "\n"), lambda line: F.regexp_count(line, F.lit("[a-zA-Z0-9]")) >= 3), "\n")
    t = sub(t, rf"\n{SPACE}*\n+", "\n\n")
    t = sub(t, r"(?md)^[\s\-]*(?:Page\s*)?\d+[\s\-]*$", "")
    t = sub(sub(t, "-{3,}", ""), r"\.{4,}", "...")
    return strip(strip_lines(t))


def normalise_layout(text: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, three or more line ends to two, stripped."""
    return strip(sub(sub(F.replace(text, F.lit("\t"), F.lit(" ")), r"[ \f\r\x0B]{2,}", " "), r"\n{3,}", "\n\n"))


def is_boundary(line: Column) -> Column:
    """A line that begins a paragraph: numbered, keyword, bullet or capitals."""
    return line.rlike(rules.BOUNDARY_NUMBERED) | line.rlike(rules.BOUNDARY_KEYWORD) | line.rlike(rules.BOUNDARY_BULLET) | line.rlike(rules.BOUNDARY_CAPS)


def is_split_heading(text: Column) -> Column:
    """The splitter's headings, which bullets are not."""
    t = strip(text)
    return t.rlike(rules.BOUNDARY_NUMBERED) | t.rlike(rules.BOUNDARY_KEYWORD) | t.rlike(rules.BOUNDARY_CAPS)


def clean_paragraph(text: Column) -> Column:
    """Spacing around punctuation; a decimal point counts as punctuation, so 1.5 becomes 1. 5. White space before a
    bracket is gone with that before other marks."""
    t = F.replace(text, F.lit("\n"), F.lit(" "))
    t = sub(t, rf"{GAP}+([.,;:)])", "$1")
    t = sub(t, r"([.,;:)])([A-Za-z0-9])", "$1 $2")
    return strip(sub(sub(t, rf"([(]){GAP}+", "$1"), "  +", " "))


def is_clause_start(text: Column) -> Column:
    """Numbered, lettered, Roman, section word, or three words in capitals with more than ten characters."""
    t = strip(text)
    first = F.array_join(F.slice(words(t), 1, 3), " ")
    # Three words without small letters hold none in their first three characters: most texts stop there.
    capitals = t.rlike("^[^a-z]{3}") & (word_total(t) >= 3) & (F.upper(first) == first) & (F.lower(first) != first) & (F.length(first) > 10)
    return t.rlike(r"^\d+(\.\d+)*\.?\s+") | t.rlike(r"(?i)^\([a-z0-9]+\)\s+") | t.rlike(r"^[IVX]+\.?\s+") | t.rlike(r"(?i)^(ARTICLE|SECTION|CLAUSE|SCHEDULE|APPENDIX|EXHIBIT)\s+") | capitals


def is_sentence_complete(text: Column) -> Column:
    """G12."""
    return strip(text).rlike(r"[.;:)]$")


def merges_with(current: Column, previous: Column) -> Column:
    """No clause start, and the previous part is open, or this one continues it."""
    c = strip(current)
    first = F.lower(F.regexp_extract(c, f"^{SOLID}+", 0))
    lower_start = F.substring(c, 1, 1).rlike(r"^\p{Ll}")
    merges = ~is_clause_start(c) & (~is_sentence_complete(previous) | lower_start | first.isin(*rules.CONTINUATION_WORDS))
    return F.coalesce(merges & (F.length(c) > 0) & (F.length(previous) > 0), F.lit(False))


def normalise_clause(text: Column) -> Column:
    """Controls and zero-width characters dropped, white space collapsed, trimmed."""
    return strip(sub(sub(text, r"[[^ -~]&&[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏﻿]]", ""), f"{SPACE}+", " "))


@F.pandas_udf(StringType())
def nfkd_ascii(text: pd.Series) -> pd.Series:
    """G17's decomposition, which Spark lacks: NFKD, then ASCII alone."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def normalise_risk(text: Column, ascii_only: bool = False) -> Column:
    """Decomposed to ASCII, white space collapsed, lower case. ascii_only: the text is ASCII already, so that the
    whole expression stays in the JVM."""
    return F.lower(strip(sub(text if ascii_only else nfkd_ascii(text), r"\s+", " ")))


def clean_summary(text: Column) -> Column:
    """G18. Of runs of blanks only those are looked for that are no single space already."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(sub(sub(sub(t, r"\n{3,}", "\n\n"), r"[ \t](?:(?<=\t)[ \t]*|[ \t]+)", " "), r"[^ -~\n]", " "))


def sentences(text: Column) -> Column:
    """Ends of sentences before a capital."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def lexical(text: Column) -> Column:
    """Lower case, punctuation to spaces, collapsed. White space is no word character either, so that one class stands
    for both; its first part rules out most characters at once."""
    return strip(sub(sub(F.lower(text), r"(?U)[[^a-z0-9 ]&&\W]", " "), " {2,}", " "))


def normalise_prompt(text: Column) -> Column:
    """G21."""
    return F.lower(strip(sub(text, f"{SPACE}+", " ")))


def truncate(text: Column, most: int = 200, mark: str = "…") -> Column:
    """Longer texts are cut and marked."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit(mark))).otherwise(text)


def snippet(text: Column, most: int = 200) -> Column:
    """G22's plain form, with three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def is_heading(text: Column) -> Column:
    """At most twelve words and numbered, or mostly capitals, or a short text with a heading keyword."""
    t = strip(text)
    capitals, letters = F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))
    numbered = t.rlike("(?i)" + "|".join(f"(?:{p})" for p in rules.HEADING_NUMBERING))
    keyword = F.upper(t).rlike("|".join(rules.HEADING_KEYWORDS)) & (F.length(t) < 100)
    return (F.length(text) > 0) & (word_total(t) <= 12) & (numbered | (capitals > letters * 0.7) | keyword)


def title_case(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def type_label(key: Column) -> Column:
    """Display name of a clause type."""
    labels = F.create_map(*(F.lit(x) for pair in rules.TYPE_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, key), title_case(key))


def risk_level(score: Column) -> Column:
    """P13."""
    return F.when(score < 3, "Low Risk").when(score < 6, "Medium Risk").otherwise("High Risk")


def confidence_band(confidence: Column) -> Column:
    """P14."""
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def allowed_extension(name: Column, allowed: tuple[str, ...] = (".pdf", ".docx")) -> Column:
    """P4."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*allowed)


def upload_problem(name: Column, size: Column, most: int = 50 * 1024 * 1024) -> Column:
    """P5: the first reason against an upload, or null."""
    missing = F.coalesce(name, F.lit("")) == ""
    return F.when(missing, "missing_name").when(~allowed_extension(name), "bad_extension").when(size > most, "too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty")


def chat_problem(message: Column, context: Column) -> Column:
    """The first reason against a message, or null."""
    m = strip(F.coalesce(message, F.lit("")))
    return F.when(m == "", "empty_message").when(F.length(m) > 2000, "message_too_long").when(F.length(context) > 50000, "context_too_long")


def stored_name(contract_id: Column, name: Column) -> Column:
    """SK1: the name a contract's file is kept under; directories in the given name are dropped."""
    return F.concat_ws("_", contract_id, F.regexp_extract(name, r"[^/\\]*$", 0))
