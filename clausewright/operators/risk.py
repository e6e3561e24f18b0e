"""Risk findings: phrases of eight rules in normalised paragraphs, escalation, document scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.functions import text as T

RULE_SCHEMA = "rule_ord int, category string, severity string, whole_word boolean, enabled boolean, keywords array<string>, template string"


def rule_table(spark, rule_set=rules.RISK_RULES) -> DataFrame:
    """The rules as a relation: one row per rule, in order."""
    rows = [(i, c, s, False, True, [k.lower() for k in ks], rules.RISK_TEMPLATES.get(c, rules.GENERIC_TEMPLATE)) for i, (c, s, ks) in enumerate(rule_set)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def add_rule(table: DataFrame, category: str, severity: str, keywords: list[str], template: str = rules.GENERIC_TEMPLATE, whole_word: bool = False) -> DataFrame:
    """P10: the rules and one more, last in order."""
    last = table.agg(F.coalesce(F.max("rule_ord") + 1, F.lit(0)).alias("rule_ord"))
    values = F.array(*(F.lit(k.lower()) for k in keywords)) if keywords else F.array().cast("array<string>")
    return table.unionByName(last.select("rule_ord", F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(whole_word).alias("whole_word"), F.lit(True).alias("enabled"), values.alias("keywords"), F.lit(template).alias("template")))


def disable_category(table: DataFrame, category: str) -> DataFrame:
    return table.withColumn("enabled", F.col("enabled") & (F.col("category") != category))


def active_rules(table: DataFrame) -> DataFrame:
    return table.filter("enabled")


def escalated(severity: Column, hits: Column, threshold: int = 2) -> Column:
    """One step up from `threshold` hits on."""
    return F.when(hits < threshold, severity).when(severity == "LOW", "MEDIUM").otherwise("HIGH")


def weight(severity: Column) -> Column:
    return reduce(lambda rest, e: F.when(severity == e[0], e[1]).otherwise(rest), rules.SEVERITY_WEIGHTS.items(), F.lit(0))


def normalised_score(raw: Column, most: float = rules.MOST_RAW_RISK) -> Column:
    """R4."""
    return F.round(F.least(raw / F.lit(float(most)), F.lit(1.0)) * 10, 2) if most > 0 else F.lit(0.0)


def first_paragraphs(paragraphs: DataFrame, ascii_only: bool = True) -> DataFrame:
    """The first paragraph of each normalised text per document, with `norm`; blanks go."""
    named = paragraphs.withColumn("norm", T.normalise_risk(F.col("text"), ascii_only)).filter("norm <> ''")
    order = Window.partitionBy("doc_id", "norm").orderBy("para_idx")
    return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def keyword_hits(norm: Column, keywords: Column, whole_word: Column) -> Column:
    """The keywords found, in their order. Each literal is a plain substring test."""
    inside = lambda k: norm.contains(k)
    alone = lambda k: F.regexp_like(norm, F.concat(F.lit(r"(?U)(?<!\w)\Q"), k, F.lit(r"\E(?!\w)")))
    return F.filter(keywords, lambda k: inside(k) & (~whole_word | alone(k)))


def template_note(found: DataFrame) -> Column:
    """R7's default: the rule's template with the phrase in its place."""
    return F.replace(found["template"], F.lit("{phrase}"), found["matched_phrase"])


def risk_matches(paragraphs: DataFrame, table: DataFrame, ascii_only: bool = True, explain=template_note) -> DataFrame:
    """At most one finding per paragraph and rule: (doc_id, para_idx, rule_ord, category, severity, matched_phrase,
    hits, explanation, text). The rule table holds a row per rule, set by its author: it is broadcast. explain: the rows
    with template, category, matched_phrase and text to the column of explanations, such as a pandas UDF's."""
    found = first_paragraphs(paragraphs, ascii_only).join(F.broadcast(active_rules(table)), F.exists("keywords", lambda k: F.col("norm").contains(k)))
    hits = found.withColumn("found", keyword_hits(F.col("norm"), F.col("keywords"), F.col("whole_word"))).filter(F.size("found") > 0)
    named = hits.select("doc_id", "para_idx", "rule_ord", "category", escalated(F.col("severity"), F.size("found")).alias("severity"), F.get("found", F.lit(0)).alias("matched_phrase"), F.size("found").alias("hits"), "template", "text")
    return named.withColumn("explanation", explain(named)).select("doc_id", "para_idx", "rule_ord", "category", "severity", "matched_phrase", "hits", "explanation", "text")


def risk_report(paragraphs: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per document, also without findings. All paragraphs count, also repeated ones; risk_score is out of 10."""
    totals = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_paragraphs"))
    found = matches.groupBy("doc_id").agg(F.sum(weight(F.col("severity"))).alias("raw"), F.countDistinct("para_idx").alias("risky_paragraph_count"), F.count(F.lit(1)).alias("n_risks"), F.count_if(F.col("severity") == "HIGH").alias("high_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    score = normalised_score(F.coalesce(F.col("raw"), F.lit(0)).cast("double"))
    return totals.join(found, "doc_id", "left").select("doc_id", score.alias("risk_score"), T.risk_level(score).alias("risk_level"), zero("n_risks").alias("n_risks"), zero("risky_paragraph_count").alias("risky_paragraph_count"), zero("high_count").alias("high_count"), "total_paragraphs")


def ranked_findings(matches: DataFrame) -> DataFrame:
    """O1: findings of a document by severity, then paragraph and rule."""
    order = Window.partitionBy("doc_id").orderBy(weight(F.col("severity")).desc(), "para_idx", "rule_ord")
    return matches.withColumn("position", F.row_number().over(order))


def category_note(category: Column) -> Column:
    """The service's note on a category: the first whose key its name holds, else the general one."""
    low = F.lower(category)
    other = F.replace(F.lit(rules.OTHER_NOTE), F.lit("{category}"), low)
    return reduce(lambda rest, e: F.when(low.contains(e[0]), e[1]).otherwise(rest), reversed(rules.CATEGORY_NOTES), other)


def report_texts(matches: DataFrame) -> DataFrame:
    """R9's texts: per document its distinct categories in order of the findings, and their distinct notes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "category"))), lambda x: x["category"])
    found = ranked_findings(matches).groupBy("doc_id").agg(F.array_distinct(ordered).alias("found"))
    notes = F.array_distinct(F.transform("found", category_note))
    return found.select("doc_id", F.array_join("found", "; ").alias("categories"), F.array_join(notes, "\n\n").alias("explanation"))


def service_report(report: DataFrame, matches: DataFrame) -> DataFrame:
    """The service's answer per document: (doc_id, risk_score, risk_level, total_paragraphs, risky_count, explanation).
    risky_count counts findings of high severity; a document without findings has the reassuring note."""
    texts = report_texts(matches).select("doc_id", "explanation")
    joined = report.join(texts, "doc_id", "left")
    return joined.select("doc_id", "risk_score", "risk_level", "total_paragraphs", F.col("high_count").alias("risky_count"), F.coalesce("explanation", F.lit(rules.NO_RISK_NOTE)).alias("explanation"))


def report_json(report: DataFrame, matches: DataFrame) -> DataFrame:
    """SK3: a document's report as JSON, findings in order."""
    listed = ranked_findings(matches).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "category", "severity", "matched_phrase", "para_idx", "explanation"))).alias("risks_detected"))
    return report.join(listed, "doc_id", "left").select("doc_id", F.to_json(F.struct("risk_score", "risks_detected", "total_paragraphs", "risky_paragraph_count")).alias("report"))
