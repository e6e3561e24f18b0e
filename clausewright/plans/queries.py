"""Registered queries: name, Spark plan over the tables of a folder, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.corpus import CORPUS_SQL, REVISED_SQL, corpus, joined, revised
from clausewright.functions import text as T
from clausewright.operators import centrality, classify, drafts, learn, match, models, nearest, quality, rate, risk, segment, sentences, sessions, summary
from clausewright.plans import folds
from clausewright.plans import sql as S
from clausewright.sources import files, images
from clausewright.sources.csv_blocks import read_quoted_csv
from clausewright.sources.files import html_text
from clausewright.sources.pdf import pdf_pages, scan_pdf
from clausewright.sources.pdf_writer import pdf_file
from clausewright.sources.shared import shared_folder, write_files
from clausewright.streaming import keyed
from clausewright.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLE_SQL[run.__name__] = oracle
        return run

    return register


LINES_SQL = r"SELECT doc_id, lang, source, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) AS l"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("text", T.strip(F.col("text")))


# Classification -------------------------------------------------------------------------------------------------------


@query(f"SELECT label, count(*) AS clause_count, round(avg(confidence), 4) AS average_confidence FROM ({S.decided(f'SELECT * FROM ({LINES_SQL}) AS q WHERE length(text) > 30', 'doc_id, line_no')}) AS d GROUP BY label")
def clause_line_counts(spark, sf_dir):
    found = classify.detect_clauses(lines(spark, sf_dir).filter(F.length("text") > 30).select("doc_id", "line_no", "text"))
    return classify.statistics(found)


@query(f"SELECT lang, source, label, count(*) AS n FROM ({S.decided(f'SELECT * FROM ({LINES_SQL}) AS q WHERE length(text) > 30', 'lang, source')}) AS d GROUP BY ROLLUP (lang, source, label)")
def clause_rollup(spark, sf_dir):
    found = classify.detect_clauses(lines(spark, sf_dir).filter(F.length("text") > 30).select("lang", "source", "text"))
    return found.rollup("lang", "source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, para_idx, label, confidence FROM ({S.decided(CORPUS_SQL)}) AS d")
def clause_best_label(spark, sf_dir):
    return classify.detect_clauses(corpus(spark, sf_dir)).select("doc_id", "para_idx", "label", "confidence")


@query(f"SELECT doc_id, para_idx, replace(clause_class, 'score_', '') AS clause_class, score FROM (UNPIVOT ({S.scores(CORPUS_SQL, 'doc_id, para_idx')}) ON COLUMNS('score_.*') INTO NAME clause_class VALUE score) AS u WHERE score > 0")
def clause_scores_long(spark, sf_dir):
    return classify.scores_long(classify.clause_scores(corpus(spark, sf_dir)))


@query(f"SELECT label, count(*) AS clause_count, round(avg(confidence), 4) AS average_confidence FROM ({S.decided(CORPUS_SQL)}) AS d GROUP BY label")
def clause_statistics(spark, sf_dir):
    return classify.statistics(classify.detect_clauses(corpus(spark, sf_dir)))


@query(
    f"""SELECT doc_id, para_idx, is_heading, label, CASE WHEN total_score = 0 THEN 0.0 WHEN is_heading AND best_score::DOUBLE / total_score > 0.3
    THEN round(least(1.0::DOUBLE, best_score::DOUBLE / total_score * 1.2::DOUBLE), 4) ELSE confidence END AS confidence FROM (SELECT *, {S.is_heading('text')} AS is_heading FROM ({S.decided(CORPUS_SQL)}) AS d) AS h"""
)
def clause_heading_boost(spark, sf_dir):
    return classify.detect_enhanced(corpus(spark, sf_dir)).select("doc_id", "para_idx", "is_heading", "label", "confidence")


@query(f"SELECT doc_id, label, arg_min(text, para_idx) AS text, min(para_idx) AS para_idx FROM ({S.decided(CORPUS_SQL)}) AS d WHERE label <> 'other' GROUP BY doc_id, label")
def clause_representatives(spark, sf_dir):
    return classify.representatives(classify.detect_clauses(corpus(spark, sf_dir)))


@query(
    f"""SELECT doc_id, para_idx, CASE WHEN confidence < 0.75 AND m > confidence THEN ['termination', 'other', 'parties'][(para_idx % 3 + 1)::INT] ELSE label END AS label,
    CASE WHEN confidence < 0.75 AND m > confidence THEN m ELSE confidence END AS confidence,
    CASE WHEN confidence >= 0.75 THEN 'rule_based' WHEN m > confidence THEN 'ml_fallback' ELSE 'rule_based_low_confidence' END AS method, confidence AS rule_confidence, CASE WHEN confidence < 0.75 THEN m END AS ml_confidence
    FROM (SELECT *, ((doc_id * 31 + para_idx * 7) % 100)::DOUBLE / 100 AS m FROM ({S.decided(CORPUS_SQL)}) AS d) AS e"""
)
def hybrid_decision(spark, sf_dir):
    """The hybrid decision, with a stand-in for the model whose answers are arithmetic on the keys."""

    def model(unsure):
        named = F.element_at(F.array(F.lit("termination"), F.lit("other"), F.lit("parties")), F.col("para_idx") % 3 + 1)
        return unsure.withColumn("ml_label", named).withColumn("ml_confidence", ((F.col("doc_id") * 31 + F.col("para_idx") * 7) % 100) / F.lit(100.0))

    return classify.cascade(classify.detect_clauses(corpus(spark, sf_dir)), model)


#: Paragraphs with the rules' decision, and what the chain model fitted on the sure ones says of each row of `asked`.
_CHAIN_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, para_idx, text, label, confidence FROM ({S.decided(CORPUS_SQL)}) AS x),
w AS (SELECT doc_id, para_idx, label, confidence, regexp_extract_all(lower(text), '\w+') AS l FROM d),
t AS MATERIALIZED (SELECT doc_id, para_idx, label, confidence, ('0x' || left(md5(step), 7))::BIGINT % {models.BUCKETS} AS bucket FROM (SELECT doc_id, para_idx, label, confidence, unnest(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN '{models.START}' ELSE l[i - 1] END || ' ' || l[i])) AS step FROM w) AS s),
c AS (SELECT label AS k, bucket, count(*) AS n FROM t WHERE confidence >= 0.75 GROUP BY ALL),
k AS (SELECT label AS k, ln(count(*) / (sum(count(*)) OVER ())) AS prior, coalesce((SELECT sum(n) FROM c WHERE c.k = label), 0) AS total FROM d WHERE confidence >= 0.75 GROUP BY label),
z AS (SELECT doc_id, para_idx, k.k, sum(ln((coalesce(c.n, 0) + 1) / (total + {models.BUCKETS})::DOUBLE)) / sqrt(count(*)) AS likely FROM t CROSS JOIN k LEFT JOIN c ON c.k = k.k AND c.bucket = t.bucket WHERE <asked> GROUP BY ALL),
g AS (SELECT a.doc_id, a.para_idx, k.k, prior + coalesce(likely, 0) AS logit FROM (SELECT * FROM d WHERE <asked>) AS a CROSS JOIN k LEFT JOIN z ON z.doc_id = a.doc_id AND z.para_idx = a.para_idx AND z.k = k.k),
m AS (SELECT doc_id, para_idx, arg_max(k, logit) AS ml_label, round(1 / sum(exp(logit - top)), 4) AS ml_confidence FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id, para_idx) AS top FROM g) AS h GROUP BY ALL)
"""


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table in the shared folder, for what is read several times."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _ruled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with the rules' decision, written once."""
    return _written(classify.detect_clauses(corpus(spark, sf_dir)), "ruled")


@query(
    _CHAIN_SQL.replace("<asked>", "confidence < 0.75")
    + """SELECT d.doc_id, d.para_idx, CASE WHEN ml_confidence > confidence THEN ml_label ELSE label END AS label, CASE WHEN ml_confidence > confidence THEN ml_confidence ELSE confidence END AS confidence,
    CASE WHEN confidence >= 0.75 THEN 'rule_based' WHEN ml_confidence > confidence THEN 'ml_fallback' ELSE 'rule_based_low_confidence' END AS method, confidence AS rule_confidence, ml_confidence FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND m.para_idx = d.para_idx"""
)
def hybrid_model_decision(spark, sf_dir):
    """The hybrid decision with a fitted sequence model: sure rules teach it, unsure paragraphs ask it."""
    return models.learned_cascade(_ruled_corpus(spark, sf_dir), "hybrid_model_decision")


@query(_CHAIN_SQL.replace("<asked>", "true") + "SELECT d.doc_id, ml_label AS label, arg_min(d.para_idx, (-ml_confidence, d.para_idx)) AS para_idx, arg_min(text, (-ml_confidence, d.para_idx)) AS text, max(ml_confidence) AS confidence FROM d JOIN m ON m.doc_id = d.doc_id AND m.para_idx = d.para_idx WHERE ml_label <> 'other' GROUP BY ALL")
def model_representatives(spark, sf_dir):
    """The paragraph of each label that the fitted model is surest of, per document."""
    ruled = _ruled_corpus(spark, sf_dir)
    models.MODELS.register("model_representatives", models.fit_chain(ruled.filter("confidence >= 0.75")), replace=True)
    return models.representatives(models.MODELS.predict(ruled, "model_representatives"))


@query(folds.map_summary("SELECT doc_id, text FROM documents"))
def clause_map_summary(spark, sf_dir):
    return classify.clause_map_summary(classify.clause_map(table(spark, sf_dir, "documents")))


_JOINED_SQL = f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para_idx) AS text FROM ({CORPUS_SQL}) AS c GROUP BY doc_id"


@query(f"SELECT doc_id, string_agg(label || ': ' || n || ' (' || round(avg_confidence * 100)::INT || '%)', chr(10) ORDER BY position) AS message FROM ({folds.map_summary(_JOINED_SQL)}) AS g WHERE position <= 10 GROUP BY doc_id")
def clause_map_messages(spark, sf_dir):
    return quality.message_view(classify.clause_map_summary(classify.clause_map(joined(corpus(spark, sf_dir)))))


@query(f"SELECT doc_id, label AS clause_type, count(*) AS n_clauses, sum(length(text))::BIGINT AS n_chars FROM ({S.decided(f'SELECT * FROM ({CORPUS_SQL}) AS q WHERE {S.strip('text')} <> {S.quote('')}')}) AS d GROUP BY doc_id, label")
def clause_groups(spark, sf_dir):
    found = classify.grouped(classify.structured(corpus(spark, sf_dir)))
    return found.select("doc_id", "clause_type", F.size("clauses").cast("long").alias("n_clauses"), F.aggregate("clauses", F.lit(0).cast("long"), lambda s, c: s + F.length(c["text"])).alias("n_chars"))


@query(f"SELECT doc_id, para_idx, label AS clause_type, CASE WHEN doc_id % 2 = 0 THEN para_idx // 3 + 1 END AS page_number FROM ({S.decided(f'SELECT * FROM ({CORPUS_SQL}) AS q WHERE {S.strip('text')} <> {S.quote('')}')}) AS d")
def clause_pages(spark, sf_dir):
    """Detections with page numbers: three paragraphs a page, known for every second contract."""
    paragraphs = corpus(spark, sf_dir)
    pages = paragraphs.filter("doc_id % 2 = 0").select("doc_id", "para_idx", (F.floor(F.col("para_idx") / 3) + 1).cast("int").alias("page_number"))
    return classify.structured(paragraphs, pages).select("doc_id", "para_idx", "clause_type", "page_number")


@query(f"SELECT doc_id, para_idx, CASE WHEN confidence < 0.3 THEN 'other' ELSE label END AS clause_type, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM ({S.decided(CORPUS_SQL)}) AS d")
def clause_predictions(spark, sf_dir):
    """Gated, formatted and banded predictions."""
    found = classify.detect_clauses(corpus(spark, sf_dir))
    made = classify.prediction(classify.accept(F.col("label"), F.col("confidence")), F.col("confidence"))
    return found.select("doc_id", "para_idx", made.alias("p"), T.confidence_band(F.col("confidence")).alias("band")).select("doc_id", "para_idx", "p.*", "band")


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, para_idx, label, confidence FROM ({S.decided(CORPUS_SQL)}) AS x),
    m AS (SELECT doc_id, para_idx, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE label END AS label, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE confidence END AS confidence FROM d),
    u AS (SELECT doc_id, bool_and(label = 'other' AND confidence = 0) AS useless FROM m GROUP BY doc_id)
    SELECT m.doc_id, para_idx, label, confidence, 'model' AS classifier FROM m JOIN u ON m.doc_id = u.doc_id AND NOT useless UNION ALL SELECT d.doc_id, para_idx, label, confidence, 'rules' FROM d JOIN u ON d.doc_id = u.doc_id AND useless"""
)
def classifier_fallback(spark, sf_dir):
    """A stand-in for a model that finds nothing in every fourth contract: there the rules answer."""
    ruled = classify.detect_clauses(corpus(spark, sf_dir)).select("doc_id", "para_idx", "label", "confidence")
    useless = F.col("doc_id") % 4 == 0
    learned = ruled.withColumn("label", F.when(useless, "other").otherwise(F.col("label"))).withColumn("confidence", F.when(useless, 0.0).otherwise(F.col("confidence")))
    return classify.with_fallback(learned, ruled)


# Risk -----------------------------------------------------------------------------------------------------------------


def _risks(spark, sf_dir):
    return risk.risk_matches(corpus(spark, sf_dir), risk.rule_table(spark))


@query(f"SELECT doc_id, para_idx, rule_ord, category, severity, matched_phrase, hits FROM ({S.risk_matches()}) AS m")
def risk_matches(spark, sf_dir):
    return _risks(spark, sf_dir).drop("explanation", "text")


_REPORT_SQL = f"""
SELECT t.doc_id, round(least(coalesce(raw, 0)::DOUBLE / 30, 1.0::DOUBLE) * 10, 2) AS risk_score, coalesce(n_risks, 0) AS n_risks, coalesce(risky, 0) AS risky_paragraph_count, coalesce(high, 0) AS high_count, total_paragraphs
FROM (SELECT doc_id, count(*) AS total_paragraphs FROM ({CORPUS_SQL}) AS c GROUP BY doc_id) AS t
LEFT JOIN (SELECT doc_id, sum({S.WEIGHT}) AS raw, count(*) AS n_risks, count(DISTINCT para_idx) AS risky, count(*) FILTER (severity = 'HIGH') AS high FROM ({S.risk_matches()}) AS m GROUP BY doc_id) AS r ON t.doc_id = r.doc_id
"""


@query(f"SELECT *, CASE WHEN risk_score < 3 THEN 'Low Risk' WHEN risk_score < 6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level FROM ({_REPORT_SQL}) AS r")
def risk_report(spark, sf_dir):
    return risk.risk_report(corpus(spark, sf_dir), _risks(spark, sf_dir))


@query(f"SELECT category, severity, count(*) AS n, count(DISTINCT doc_id) AS n_contracts FROM ({S.risk_matches()}) AS m GROUP BY category, severity")
def risk_by_category(spark, sf_dir):
    return _risks(spark, sf_dir).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_contracts"))


@query(f"SELECT doc_id, string_agg(category, '; ' ORDER BY p) AS categories FROM (SELECT doc_id, category, min(p) AS p FROM (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY {S.WEIGHT} DESC, para_idx, rule_ord) AS p FROM ({S.risk_matches()}) AS m) AS n GROUP BY doc_id, category) AS o GROUP BY doc_id")
def risk_report_texts(spark, sf_dir):
    return risk.report_texts(_risks(spark, sf_dir)).select("doc_id", "categories")


_TEMPLATES = " ".join(f"WHEN {S.quote(c)} THEN {S.quote(rules.RISK_TEMPLATES.get(c, rules.GENERIC_TEMPLATE))}" for c, _, _ in rules.RISK_RULES)


@query(f"SELECT doc_id, para_idx, rule_ord, replace(CASE category {_TEMPLATES} END, '{{phrase}}', matched_phrase) AS explanation FROM ({S.risk_matches()}) AS m")
def risk_explanations(spark, sf_dir):
    return _risks(spark, sf_dir).select("doc_id", "para_idx", "rule_ord", "explanation")


_NOTE = "CASE " + " ".join(f"WHEN contains(lower(category), {S.quote(k)}) THEN {S.quote(note)}" for k, note in rules.CATEGORY_NOTES) + f" ELSE replace({S.quote(rules.OTHER_NOTE)}, '{{category}}', lower(category)) END"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {S.WEIGHT} DESC, para_idx, rule_ord) AS p FROM ({S.risk_matches()}) AS m"


@query(
    f"""SELECT r.doc_id, risk_score, CASE WHEN risk_score < 3 THEN 'Low Risk' WHEN risk_score < 6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level, total_paragraphs, high_count AS risky_count, coalesce(explanation, {S.quote(rules.NO_RISK_NOTE)}) AS explanation
    FROM ({_REPORT_SQL}) AS r LEFT JOIN (SELECT doc_id, string_agg(note, chr(10) || chr(10) ORDER BY p) AS explanation FROM (SELECT doc_id, {_NOTE} AS note, min(p) AS p FROM ({_RANKED}) AS n GROUP BY 1, 2) AS o GROUP BY doc_id) AS e ON r.doc_id = e.doc_id"""
)
def risk_service(spark, sf_dir):
    found = _risks(spark, sf_dir)
    return risk.service_report(risk.risk_report(corpus(spark, sf_dir), found), found)


@query(f"SELECT doc_id, p::INT AS position, category, severity, matched_phrase, para_idx, replace(CASE category {_TEMPLATES} END, '{{phrase}}', matched_phrase) AS explanation FROM ({_RANKED}) AS r")
def risk_report_fields(spark, sf_dir):
    """The findings of risk_report_json, read back from its JSON."""
    schema = "risk_score double, risks_detected array<struct<position:int,category:string,severity:string,matched_phrase:string,para_idx:int,explanation:string>>"
    found = risk_report_json(spark, sf_dir).select("doc_id", F.inline(F.from_json("report", schema)["risks_detected"]))
    return found


@query()
def risk_report_json(spark, sf_dir):
    found = _risks(spark, sf_dir)
    return risk.report_json(risk.risk_report(corpus(spark, sf_dir), found), found)


@query(f"SELECT doc_id, para_idx FROM (SELECT doc_id, para_idx, {S.strip(S.sub('lower(text)', r'\s+', ' '))} AS norm FROM ({CORPUS_SQL}) AS c) AS n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY para_idx) = 1")
def paragraph_dedupe(spark, sf_dir):
    return risk.first_paragraphs(corpus(spark, sf_dir)).select("doc_id", "para_idx")


# Cleaning and segmentation --------------------------------------------------------------------------------------------


@query(folds.PARAGRAPHS)
def split_structural(spark, sf_dir):
    return segment.split_structural(table(spark, sf_dir, "documents"))


@query(
    f"""SELECT doc_id, g AS para_idx, {S.clean_paragraph('text')} AS text FROM (
    SELECT doc_id, g, string_agg(glue || text, '' ORDER BY para_idx) AS text FROM (
      SELECT *, (sum(starts) OVER (PARTITION BY doc_id ORDER BY para_idx) - 1)::INT AS g, CASE WHEN starts = 1 OR regexp_matches(previous, '[ -]$') THEN '' ELSE ' ' END AS glue FROM (
        SELECT *, CASE WHEN previous IS NULL OR NOT ((NOT {S.is_clause_start('text')}) AND (NOT regexp_matches(previous, '[.;:)]$') OR regexp_matches(text, '^\\p{{Ll}}') OR lower(regexp_extract(text, '\\S+')) IN ({', '.join(map(S.quote, rules.CONTINUATION_WORDS))}))) THEN 1 ELSE 0 END AS starts FROM (
          SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY para_idx) AS previous FROM (SELECT doc_id, para_idx, {S.clean_paragraph('text')} AS text FROM ({CORPUS_SQL}) AS c) AS a WHERE text <> '') AS b) AS d) AS e GROUP BY doc_id, g) AS f"""
)
def restructure_merge(spark, sf_dir):
    return segment.restructure(corpus(spark, sf_dir))


@query(folds.ORPHANS)
def merge_short_orphans(spark, sf_dir):
    parts = segment.ordered_texts(segment.split_structural(table(spark, sf_dir, "documents")))
    return segment.numbered(parts.select("doc_id", segment.merge_orphans(F.col("parts")).alias("parts")))


@query(folds.chunks("SELECT doc_id, text FROM documents"))
def clause_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(segment.clause_chunks(F.col("text"))).alias("para_idx", "text"))


@query(folds.overlapping("SELECT doc_id, text FROM documents"))
def overlap_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(segment.overlap_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query(f"SELECT doc_id, md5({S.clean_paragraph('text')}) AS digest FROM documents")
def paragraph_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_paragraph(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({S.clean_ocr('text')}) AS digest FROM documents")
def ocr_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_ocr(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({S.strip(S.sub(S.sub('text', '[ \\t]+', ' '), '[^\\x20-\\x7E\\n]', ' '))}) AS summary_digest, md5(lower({S.strip(S.sub('text', '\\s+', ' '))})) AS prompt_digest FROM documents")
def text_normalise(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_summary(t)).alias("summary_digest"), F.md5(T.normalise_prompt(t)).alias("prompt_digest"))


@query(f"SELECT doc_id, md5(lower({S.strip(S.sub(S.sub('strip_accents(text)', '[^\\x00-\\x{7F}]', ''), '\\s+', ' '))})) AS digest FROM documents")
def risk_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_risk(F.col("text"))).alias("digest"))


@query(
    f"""SELECT doc_id, md5({S.strip(S.sub(f"array_to_string(list_transform(string_split({S.sub(S.sub("replace(text, chr(0), '')", ' +', ' '), '[\\n][ \\t\\f\\r\\n]*[\\n]+', 'Z').replace("'Z'", "chr(10) || chr(10)")}, chr(10)), lambda x: {S.strip('x')}), chr(10))", '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{7F}-\\x{9F}]', ''))}) AS digest FROM documents"""
)
def extract_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_extracted(F.col("text"))).alias("digest"))


_FLAT = lambda parts, least: f"len(list_filter(list_transform({parts}, lambda p: {S.strip(S.sub('replace(p, chr(10), chr(32))', ' +', ' '))}), lambda p: length(p) {least}))"
_FULL = lambda separator: f"list_filter(list_transform(string_split(text, {separator}), lambda p: {S.strip('p')}), lambda p: p <> '')"


@query(
    f"""SELECT doc_id, {_FLAT('string_split(text, chr(10) || chr(10))', '> 10')}::INT AS n_extract, {_FLAT(f"regexp_split_to_array(text, {S.quote('[\\n][ \\t\\f\\r\\n]*[\\n]')})", '>= 20')}::INT AS n_ocr, len(CASE WHEN len(parts) = 0 THEN lines ELSE parts END)::INT AS n_legacy, len(CASE WHEN len(parts) < 5 THEN lines ELSE parts END)::INT AS n_legacy_few, len(parts)::INT AS n_blank
    FROM (SELECT doc_id, text, {_FULL('chr(10) || chr(10)')} AS parts, {_FULL('chr(10)')} AS lines FROM documents) AS d"""
)
def simple_splits(spark, sf_dir):
    """Parts that each of the plain splitters finds."""
    kinds = ("extract", "ocr", "legacy", "legacy_few", "blank")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(segment.simple_split(F.col("text"), k)).alias(f"n_{k}") for k in kinds))


#: Ten lines are a page; every third page has no text layer, and what is recognised there is in small letters.
_PAGES_SQL = f"SELECT doc_id, (line_no // 10 + 1)::INT AS page_no, CASE WHEN (doc_id + line_no // 10) % 3 = 0 THEN '' ELSE string_agg(text, chr(10) ORDER BY line_no) END AS layer, lower(string_agg(text, chr(10) ORDER BY line_no)) AS recognised FROM ({LINES_SQL}) AS l GROUP BY doc_id, line_no // 10"


def _pages(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    paged = lines(spark, sf_dir).withColumn("p", F.floor(F.col("line_no") / 10)).groupBy("doc_id", "p").agg(text.alias("t"))
    empty = (F.col("doc_id") + F.col("p")) % 3 == 0
    return paged.select(F.col("doc_id").alias("path"), (F.col("p") + 1).cast("int").alias("page_no"), F.when(empty, "").otherwise(F.col("t")).alias("text"), F.lower("t").alias("recognised"))


@query(f"SELECT doc_id, page_no, md5(CASE WHEN length({S.strip('layer')}) > 30 THEN layer WHEN {S.strip('recognised')} <> '' THEN recognised ELSE layer END) AS digest FROM ({_PAGES_SQL}) AS p WHERE {S.strip('layer')} <> '' OR {S.strip('recognised')} <> ''")
def page_texts(spark, sf_dir):
    """The text layer or the recognised text, page by page."""
    pages = _pages(spark, sf_dir)
    chosen = files.chosen_pages(pages.drop("recognised"), pages.select("path", "page_no", F.col("recognised").alias("text")))
    return chosen.select(F.col("path").alias("doc_id"), "page_no", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, count(*) AS num_pages, coalesce(avg(length({S.strip('layer')})) FILTER (page_no <= 3) < 100, true) AS is_scanned FROM ({_PAGES_SQL}) AS p GROUP BY doc_id")
def page_statistics(spark, sf_dir):
    pages = _pages(spark, sf_dir).drop("recognised")
    found = files.page_counts(pages).join(files.scanned_files(pages), "path", "left")
    return found.select(F.col("path").alias("doc_id"), "num_pages", F.coalesce("is_scanned", F.lit(True)).alias("is_scanned"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_HTML = S.sub(S.sub("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, {S.quote(_entity)}, {S.quote(_plain)})"


@query(f"SELECT page_id, trim({S.sub(_HTML, '[ \\t\\r\\n]+', ' ')}) AS text FROM pages")
def html_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, para_idx AS id, text, {folds.split_heading('text')} AS is_heading, length(text)::INT AS char_count FROM ({CORPUS_SQL}) AS c")
def pipeline_records(spark, sf_dir):
    return segment.pipeline_records(corpus(spark, sf_dir))


@query(f"SELECT doc_id, len(l)::INT AS n_sentences, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, {folds.sentences('text')} AS l FROM documents) AS d")
def sentence_split(spark, sf_dir):
    found = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_sentences"), F.md5(F.array_join(found, "|")).alias("digest"))


#: Some words always carry a period within sentences, as abbreviations do.
_ABBREVIATED_SQL = r"SELECT doc_id, regexp_replace(text, '(^| )(tion|ist|zu|en|el|ou) ', '\1\2. ', 'g') AS text FROM documents"


def _abbreviated(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "(^| )(tion|ist|zu|en|el|ou) ", "$1$2. "))


@query(f"WITH {folds.sentence_parts(_ABBREVIATED_SQL)} SELECT 'abbreviation' AS kind, word, NULL AS next, round(score, 3) AS score FROM abbr UNION ALL SELECT 'collocation', word, next, NULL FROM coll UNION ALL SELECT 'starter', word, NULL, NULL FROM starters")
def sentence_model(spark, sf_dir):
    """Abbreviations, collocations and sentence starters, learned from all documents."""
    model = sentences.train(_abbreviated(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    rows = model.abbreviations.select(F.lit("abbreviation").alias("kind"), "word", none("string").alias("next"), F.round("score", 3).alias("score"))
    rows = rows.unionByName(model.collocations.select(F.lit("collocation").alias("kind"), "word", "next", none("double").alias("score")))
    return rows.unionByName(model.starters.select(F.lit("starter").alias("kind"), "word", none("string").alias("next"), none("double").alias("score")))


@query(
    f"""SELECT d.doc_id, coalesce(n, 0) AS n_sentences, md5(coalesce(whole, '')) AS digest FROM documents AS d LEFT JOIN (SELECT doc_id, count(*)::INT AS n, string_agg(sentence, '|' ORDER BY g) AS whole
    FROM (SELECT doc_id, g, regexp_replace(string_agg(token, '' ORDER BY place), '[ \\t\\n\\f\\r]+$', '') AS sentence FROM (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
    FROM ({folds.trained_sentences(_ABBREVIATED_SQL)}) AS a) AS b GROUP BY doc_id, g) AS c GROUP BY doc_id) AS e ON d.doc_id = e.doc_id"""
)
def sentence_boundaries(spark, sf_dir):
    """Sentences of all documents by the model that they themselves give."""
    docs = _abbreviated(spark, sf_dir)
    found = sentences.boundaries(docs, sentences.train(docs))
    return found.select("doc_id", F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", "|")).alias("digest"))


@query(f"SELECT doc_id, md5({S.strip(S.sub(S.sub('lower(text)', '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]', ' '), '\\s+', ' '))}) AS digest FROM documents")
def lexical_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.lexical(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9)) <> ''), chr(10) || chr(10))) AS digest, 0::BIGINT AS num_pages, 'docx' AS source_type FROM documents")
def docx_extract(spark, sf_dir):
    """Every document as a DOCX file, a paragraph for each line, and its text read back."""

    @F.pandas_udf("binary")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: files.docx_file(t.split("\n")))

    plain = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", "")
    stored = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), written(plain).alias("content"))
    found = files.extract_documents(stored)
    return found.select(F.regexp_extract("path", r"^(-?\d+)", 1).cast("long").alias("doc_id"), F.md5("raw_text").alias("digest"), "num_pages", "source_type")


#: Lines as a PDF can show them: without controls, single blanks, none at the ends; pages of forty. The second page of
#: some files is broken.
_PRINTED_SQL = r"SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '[\x00-\x08\x0B-\x1F]', '', 'g'), '[ \t]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) AS a) AS b WHERE line <> ''"
PAGE_LINES = 40


def _printed(spark, sf_dir, broken=False):
    """(path, content): every document as a PDF file, by its id with or without compression, whole lines or words."""

    def printed(batches):
        make = lambda i, own: pdf_file([list(own[k : k + PAGE_LINES]) for k in range(0, len(own), PAGE_LINES)], i % 2 == 0, i % 3 == 0, (2,) if broken and i % 7 == 3 else ())
        for batch in batches:  # as plain lists of Arrow, a few files at a time
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                ids, shown = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = [make(i, own or []) for i, own in zip(ids, shown)]
                yield pa.RecordBatch.from_arrays([pa.array([None if i is None else f"{i}.pdf" for i in ids], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    # Neither pattern meets a line's end, so that a text is cleaned once and not line by line; a single blank may stay.
    clean = T.sub(T.sub(F.col("text"), r"[\x00-\x08\x0B-\x1F]", ""), r"[ \t]{2,}|\t", " ")
    shown = F.filter(F.transform(F.split(clean, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("shown")).mapInArrow(printed, "path string, content binary")


@query(f"SELECT doc_id, (n // {PAGE_LINES} + 1)::INT AS page_no, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM ({_PRINTED_SQL}) AS p GROUP BY doc_id, n // {PAGE_LINES} HAVING NOT (doc_id % 7 = 3 AND n // {PAGE_LINES} = 1)")
def pdf_text_layer(spark, sf_dir):
    """Every document as a PDF file in the shared folder, read back by ranges of pages; broken pages are left out."""
    folder = f"{shared_folder(spark)}/pdf-{uuid.uuid4().hex}"
    write_files(_printed(spark, sf_dir, broken=True), folder)
    return scan_pdf(spark, folder, 20_000).select(F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long").alias("doc_id"), "page_no", F.md5("text").alias("digest"))


@query(
    f"""SELECT d.doc_id, md5(coalesce(r.text, '')) AS digest, coalesce(num_pages, 0) AS num_pages, CASE WHEN coalesce(size, 0) < 100 THEN 'scanned' ELSE 'digital' END AS source_type
    FROM documents AS d LEFT JOIN (SELECT doc_id, string_agg(page, chr(10) ORDER BY n) AS text, count(*) AS num_pages, avg(length(page)) FILTER (n < 3) AS size
    FROM (SELECT doc_id, n // {PAGE_LINES} AS n, string_agg(line, chr(10) ORDER BY n) AS page FROM ({_PRINTED_SQL}) AS p GROUP BY doc_id, n // {PAGE_LINES}) AS q GROUP BY doc_id) AS r ON d.doc_id = r.doc_id"""
)
def pdf_extract(spark, sf_dir):
    """The same files by the format dispatch, which takes the text layer page by page."""
    found = files.extract_documents(_printed(spark, sf_dir), pdf_pages)
    return found.select(F.regexp_extract("path", r"^(-?\d+)", 1).cast("long").alias("doc_id"), F.md5("raw_text").alias("digest"), "num_pages", "source_type")


# Streams --------------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, run):
    """The events as a stream of files, in a session of its own that has the state store which list states need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = own.readStream.schema(own.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    run(own, events.withColumn("ts", F.col("ts").cast("timestamp")), folder)
    return folder


@query(
    """SELECT user_id, event_id, session_start, created, len(history)::INT AS n_messages, array_to_string(history, ',') AS history FROM (
    SELECT user_id, event_id, ts, created, min(ts) OVER (PARTITION BY user_id, n) AS session_start, list(event_id) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS history
    FROM (SELECT *, sum(created::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS created FROM events) AS a) AS b) AS c"""
)
def stream_sessions_of_events(spark, sf_dir):
    """Session states of all events, kept by a stream with list state and timers."""

    def run(own, events, folder):
        kept = keyed.stream_session_states(events.select("user_id", "event_id", "ts"))
        kept.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()

    folder = _streamed(spark, sf_dir, run)
    return spark.read.schema(keyed.ACCESS).parquet(f"{folder}/out").withColumn("history", F.array_join("history", ","))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest_events(spark, sf_dir):
    """The latest event of each user, as a table that micro-batches keep."""
    schema = "user_id bigint, ts timestamp, event_id bigint, event_type string"

    def run(own, events, folder):
        keyed.UpsertTable(own, f"{folder}/table", schema, "user_id", "ts").start(events, f"{folder}/checkpoint").awaitTermination()

    folder = _streamed(spark, sf_dir, run)
    return keyed.UpsertTable(spark, f"{folder}/table", schema, "user_id", "ts").read()


@query("SELECT doc_id, md5(text) AS digest, source FROM documents")
def csv_records(spark, sf_dir):
    """All documents as quoted CSV files in the shared folder, read back by blocks that cut records anywhere."""

    def made(batches):
        # Files of some rows: one of a whole batch would stand in memory several times.
        for batch in (whole.iloc[i : i + 1000] for whole in batches for i in range(0, len(whole), 1000)):
            name, held = f"{batch['doc_id'].iloc[0]}.csv", batch.to_csv(index=False, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
            yield pd.DataFrame({"path": [name], "content": [held.encode()]})

    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source").mapInPandas(made, "path string, content binary"), folder)
    return read_quoted_csv(spark, folder, 200_000).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "source")


# Matching -------------------------------------------------------------------------------------------------------------

THRESHOLDS = {"identical": 0.40, "modified": 0.37, "related": 0.34}


def _sides(spark, sf_dir):
    """Vectors stand in for clauses: a contract is a label, version a the even ids, version b the odd ones."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").cast("int").alias("idx"), F.col("vec_id").cast("string").alias("clause"), F.col("embedding").alias("vector"))
    return vectors.filter("idx % 2 = 0"), vectors.filter("idx % 2 = 1")


_PAIRS_SQL = "SELECT a.label AS doc_id, a.vec_id::INT AS idx_a, b.vec_id::INT AS idx_b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"
_BEST_SQL = f"SELECT * FROM ({_PAIRS_SQL}) AS p QUALIFY row_number() OVER (PARTITION BY doc_id, idx_a ORDER BY similarity DESC, idx_b) = 1"
_STATUS_SQL = f"""
WITH found AS (SELECT a.label AS doc_id, a.vec_id::INT AS idx_a, coalesce(b.similarity, -1.0::DOUBLE) AS similarity, b.idx_b AS best FROM embeddings a LEFT JOIN ({_BEST_SQL}) b ON a.label = b.doc_id AND a.vec_id = b.idx_a WHERE a.vec_id % 2 = 0),
judged AS (SELECT *, CASE WHEN similarity >= 0.40 THEN 'identical' WHEN similarity >= 0.37 THEN 'modified' WHEN similarity >= 0.34 THEN 'related' ELSE 'removed' END AS status FROM found)
SELECT doc_id, status, idx_a, CASE WHEN status <> 'removed' THEN best END AS idx_b, similarity FROM judged
UNION ALL
SELECT label, 'added', NULL, vec_id::INT, NULL FROM embeddings e WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.doc_id = e.label AND j.best = e.vec_id AND j.status <> 'removed')
"""


@query(_PAIRS_SQL)
def similarity_matrix(spark, sf_dir):
    return match.similarities(*_sides(spark, sf_dir))


@query(f"SELECT doc_id, idx_a, idx_b, similarity, row_number() OVER (PARTITION BY doc_id, idx_a ORDER BY similarity DESC, idx_b)::INT AS rank FROM ({_PAIRS_SQL}) AS p QUALIFY rank <= 3")
def similarity_topk(spark, sf_dir):
    return match.top_k(*_sides(spark, sf_dir), 3)


@query("SELECT q.vec_id AS query_id, m.vec_id AS match_id, round(list_dot_product(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, m.vec_id)::INT AS rank FROM embeddings q JOIN embeddings m ON q.vec_id % 20 = 0 QUALIFY rank <= 5")
def vector_search(spark, sf_dir):
    """Exact nearest neighbours: every twentieth vector asks, all vectors answer."""
    vectors = table(spark, sf_dir, "embeddings")
    return match.top_k_blocked(vectors.filter("vec_id % 20 = 0"), vectors, 5)


@query("SELECT q.vec_id AS query_id, m.vec_id AS match_id, round(list_dot_product(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, m.vec_id)::INT AS rank FROM embeddings q JOIN embeddings m ON q.vec_id % 20 = 0 QUALIFY rank <= 5")
def vector_search_pruned(spark, sf_dir):
    """The same neighbours from the blocks alone that bounds do not rule out."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.top_k_pruned(vectors.filter("vec_id % 20 = 0"), vectors, 5)


@query(_STATUS_SQL)
def compare_status(spark, sf_dir):
    return match.classify_changes(*_sides(spark, sf_dir), **THRESHOLDS).drop("clause_a", "clause_b")


@query(
    f"""SELECT doc_id, n_added, n_removed, n_modified, n_similar, CASE WHEN n_added + n_removed + n_modified + n_similar = 0 THEN 'No differences detected.' ELSE concat_ws('. ', CASE WHEN n_added > 0 THEN n_added || ' clause(s) added' END, CASE WHEN n_removed > 0 THEN n_removed || ' clause(s) removed' END,
    CASE WHEN n_modified > 0 THEN n_modified || ' clause(s) modified' END, CASE WHEN n_similar > 0 THEN n_similar || ' clause(s) unchanged or similar' END) || '.' END AS change_summary
    FROM (SELECT doc_id, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'modified') AS n_modified, count(*) FILTER (status IN ('identical', 'related')) AS n_similar FROM ({_STATUS_SQL}) AS s GROUP BY doc_id) AS c"""
)
def compare_change_summary(spark, sf_dir):
    return match.change_summary(match.classify_changes(*_sides(spark, sf_dir), **THRESHOLDS))


_ITEMS = lambda s, text="clause": f"coalesce(string_agg({text}, ';' ORDER BY status, idx_a, idx_b) FILTER (status IN ({s})), '')"
_ITEM = "concat_ws('|', idx_a::VARCHAR, coalesce(idx_b::VARCHAR, '-'), similarity::DECIMAL(12, 6)::VARCHAR, status)"


@query(f"SELECT doc_id, {_ITEMS(S.quote('added'), 'idx_b::VARCHAR')} AS added_clauses, {_ITEMS(S.quote('removed'), _ITEM)} AS removed_clauses, {_ITEMS(S.quote('modified'), _ITEM)} AS modified_clauses, {_ITEMS(S.quote('identical') + ', ' + S.quote('related'), _ITEM)} AS similar_clauses FROM ({_STATUS_SQL}) AS s GROUP BY doc_id")
def compare_response(spark, sf_dir):
    """The typed answer per contract, its items as texts."""
    sides = _sides(spark, sf_dir)
    typed = match.response(match.classify_changes(*sides, **THRESHOLDS), sides[0].unionByName(sides[1]))
    item = lambda x: F.concat_ws("|", x["clause_a"], F.coalesce(x["clause_b"], F.lit("-")), x["similarity"].cast("decimal(12,6)").cast("string"), x["status"])
    return typed.select("doc_id", F.array_join("added_clauses", ";").alias("added_clauses"), *(F.array_join(F.transform(n, item), ";").alias(n) for n in match.RESPONSE))


@query(f"SELECT doc_id, string_agg(format('[{{}}] {{}} -> {{}}', status, coalesce(idx_a::VARCHAR, '-'), coalesce(idx_b::VARCHAR, '-')), chr(10) ORDER BY coalesce(idx_a, 2147483647), coalesce(idx_b, -1)) AS report FROM ({_STATUS_SQL}) AS s GROUP BY doc_id")
def compare_report(spark, sf_dir):
    return match.report(match.classify_changes(*_sides(spark, sf_dir), **THRESHOLDS), "text")


def _clauses_sql(source: str) -> str:
    """Clauses as preprocess() gives them."""
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS idx, clause FROM (SELECT doc_id, clause, min(para_idx) AS p FROM (SELECT doc_id, para_idx, {S.strip(S.sub('text', r'\s+', ' '))} AS clause FROM ({source}) AS r) AS n WHERE clause <> '' GROUP BY doc_id, clause) AS f"


def _vectors_sql(source: str) -> str:
    """Entries of the unit vectors of hashed words and word pairs."""
    return rf"""SELECT doc_id, idx, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, idx)))::FLOAT::DOUBLE AS x FROM (
      SELECT doc_id, idx, ('0x' || left(md5(w), 7))::BIGINT % {match.DIMENSIONS} AS bucket, count(*)::DOUBLE AS n FROM (
        SELECT doc_id, idx, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS w FROM (SELECT doc_id, idx, regexp_extract_all(lower(clause), '\w+') AS l FROM ({_clauses_sql(source)}) AS c) AS t) AS u GROUP BY 1, 2, 3) AS k"""


@query(
    f"""WITH a AS MATERIALIZED ({_clauses_sql(CORPUS_SQL)}), b AS MATERIALIZED ({_clauses_sql(REVISED_SQL)}),
    p AS (SELECT doc_id, i AS idx_a, j AS idx_b, round(sum(s), 6) AS similarity FROM (
      SELECT x.doc_id, x.idx AS i, y.idx AS j, x.x * y.x AS s FROM ({_vectors_sql(CORPUS_SQL)}) AS x JOIN ({_vectors_sql(REVISED_SQL)}) AS y ON x.doc_id = y.doc_id AND x.bucket = y.bucket
      UNION ALL SELECT a.doc_id, a.idx, b.idx, 0.0 FROM a JOIN b ON a.doc_id = b.doc_id) AS q GROUP BY 1, 2, 3),
    t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, idx_a ORDER BY similarity DESC, idx_b) = 1),
    f AS (SELECT a.doc_id, a.idx AS idx_a, a.clause AS clause_a, t.idx_b AS best, coalesce(similarity, -1.0::DOUBLE) AS similarity FROM a LEFT JOIN t ON a.doc_id = t.doc_id AND a.idx = t.idx_a),
    j AS (SELECT *, CASE WHEN similarity >= {match.IDENTICAL} THEN 'identical' WHEN similarity >= {match.MODIFIED} THEN 'modified' WHEN similarity >= {match.RELATED} THEN 'related' ELSE 'removed' END AS status FROM f)
    SELECT j.doc_id, status, idx_a, b.idx AS idx_b, clause_a, b.clause AS clause_b, similarity FROM j LEFT JOIN b ON j.doc_id = b.doc_id AND j.best = b.idx AND status <> 'removed'
    UNION ALL SELECT doc_id, 'added', NULL, idx, NULL, clause, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.doc_id = b.doc_id AND j.best = b.idx AND j.status <> 'removed')"""
)
def compare_contracts(spark, sf_dir):
    """Both versions of every contract, by hashed word vectors."""
    paragraphs = corpus(spark, sf_dir)
    return match.compare(paragraphs, revised(paragraphs))


@query(_clauses_sql(REVISED_SQL))
def clause_dedupe(spark, sf_dir):
    return match.preprocess(revised(corpus(spark, sf_dir)))


# Summaries ------------------------------------------------------------------------------------------------------------

_SECTION_CASES = " UNION ALL ".join(f"SELECT doc_id, para_idx, text, '{s}' AS section FROM c WHERE regexp_matches(lower(text), {S.quote(p)})" for s, p in rules.SECTION_PATTERNS.items())


@query(
    f"""WITH c AS (SELECT * FROM ({CORPUS_SQL}) AS q WHERE {S.words('text')} > 5),
    first AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY para_idx) AS n FROM ({_SECTION_CASES}) AS t QUALIFY n <= 8)
    SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY min(n))::INT AS position, text AS sentence FROM first GROUP BY doc_id, section, text"""
)
def summary_sections(spark, sf_dir):
    """Paragraphs of the corpus are single sentences for the most part; here each is one."""
    return summary.sections(corpus(spark, sf_dir).select("doc_id", F.col("para_idx").alias("sentence_no"), F.col("text").alias("sentence")))


def _summaries(spark, sf_dir):
    return summary.summarise(joined(corpus(spark, sf_dir)))


@query(folds.summaries(_JOINED_SQL))
def contract_summaries(spark, sf_dir):
    """Lists as texts, a line for each entry."""
    lists = ("key_points", "obligations", "payment_terms", "termination", "risks")
    return _summaries(spark, sf_dir).select("doc_id", "overall_summary", *(F.array_join(c, "\n").alias(c) for c in lists))


@query(f"SELECT doc_id, chunk_no, n_sentences, md5(ranks) AS ranks, md5(summary) AS summary FROM ({folds.central_chunks('SELECT doc_id, text FROM documents', centrality.START, centrality.OWN, centrality.FLOWS, centrality.ROUNDS, centrality.MOST_WORDS)}) AS c")
def chunk_centrality(spark, sf_dir):
    """Every chunk of every document with the ranks of its sentences and the summary that they give."""
    found = centrality.central_chunks(overlap_chunks(spark, sf_dir))
    return found.select("doc_id", "chunk_no", F.size("sentences").alias("n_sentences"), F.md5(F.concat_ws(",", F.col("ranks").cast("array<string>"))).alias("ranks"), F.md5("summary").alias("summary"))


_EXPLAINED_SQL = f"SELECT doc_id, summary, key_points, {S.quote(summary.PLAIN_PROMPT)} || summary AS prompt, CASE WHEN len(first) > 0 THEN 'In short: ' || array_to_string(first, ' ') ELSE '' END AS explanation FROM (SELECT doc_id, overall_summary AS summary, key_points, {folds.sentences('overall_summary')}[:2] AS first FROM ({folds.summaries(_JOINED_SQL)}) AS s WHERE trim(overall_summary) <> '') AS e"


@query(_EXPLAINED_SQL)
def summary_explanations(spark, sf_dir):
    """Each summary with the request for a plain-language explanation, and the default answer to it."""
    return summary.explained(_summaries(spark, sf_dir)).withColumn("key_points", F.array_join("key_points", "\n"))


@query(f"SELECT doc_id, concat_ws(chr(10), nullif({S.strip('summary')}, ''), chr(10) || '**Key points**' || chr(10) || '- ' || replace(key_points, chr(10), chr(10) || '- '), CASE WHEN trim(explanation) <> '' THEN chr(10) || '**In plain language**' || chr(10) || {S.strip('explanation')} END) AS message FROM ({_EXPLAINED_SQL}) AS m")
def summary_messages(spark, sf_dir):
    return summary.summary_message(summary.explained(_summaries(spark, sf_dir)))


# Chat -----------------------------------------------------------------------------------------------------------------

#: Questions put before each message, by conversation and turn, as the messages themselves hold no intent.
QUESTIONS = ("Please list all the clauses. ", "Give me a summary of this. ", "Are there any risks here? ", "Compare these versions. ", "Draft something new. ", "Explain Bachan Singh to me. ", "What about force majeure? ", "hello ", "Who owns the copyright? ", "")
_MESSAGES_SQL = f"SELECT conv_id, turn, concat([{', '.join(map(S.quote, QUESTIONS))}][((conv_id + turn) % {len(QUESTIONS)} + 1)::INT], text) AS message, CASE WHEN turn % 3 = 2 THEN text END AS given FROM conversations"


def _messages(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(asked, "text").alias("message"), F.when(F.col("turn") % 3 == 2, F.col("text")).alias("given"))


_INTENT = S.first_match("message", rules.INTENT_PATTERNS, "'GENERAL'")


@query(f"SELECT conv_id, turn, {_INTENT} AS intent, CASE WHEN {S.strip('message')} = '' OR {S.first_match('message', rules.INTENT_PATTERNS)} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM ({_MESSAGES_SQL}) AS m")
def intent_detect(spark, sf_dir):
    named, confidence = classify.intent(F.col("message"))
    return _messages(spark, sf_dir).select("conv_id", "turn", named.alias("intent"), confidence.alias("confidence"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(message), {S.quote(w)})' for w in ws)} THEN '{k}'" for k, ws in rules.KEYWORD_INTENTS) + f" ELSE 'GENERAL' END AS intent FROM ({_MESSAGES_SQL}) AS m")
def keyword_intents(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", classify.keyword_intent(F.col("message")).alias("intent"))


@query(f"SELECT conv_id, turn, coalesce({S.first_match('message', rules.KNOWLEDGE_PATTERNS)}, 'fallback') AS answer FROM ({_MESSAGES_SQL}) AS m")
def kb_answer(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", F.coalesce(classify.answer_key(F.col("message")), F.lit("fallback")).alias("answer"))


@query(f"SELECT conv_id, turn, coalesce({S.first_match('message', rules.KNOWLEDGE_PATTERNS + rules.RESPONDER_PATTERNS)}, 'fallback') AS answer FROM ({_MESSAGES_SQL}) AS m")
def responder_answer(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", F.coalesce(classify.answer_key(F.col("message"), responder=True), F.lit("fallback")).alias("answer"))


@query(
    f"""SELECT conv_id, turn, intent, CASE intent WHEN 'SUMMARY' THEN 'summarise' WHEN 'RISK' THEN 'risk_report' WHEN 'CLAUSE_MAP' THEN CASE WHEN context IS NULL THEN 'ask_for_contract' ELSE 'clause_map' END
    WHEN 'COMPARE' THEN 'ask_for_two_contracts' WHEN 'DRAFT' THEN 'draft_templates' ELSE 'knowledge_base' END AS route
    FROM (SELECT conv_id, turn, context, CASE WHEN i IN ('SUMMARY', 'RISK', 'COMPARE') AND context IS NULL THEN 'GENERAL' ELSE i END AS intent
      FROM (SELECT *, {_INTENT} AS i, last_value(given IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM ({_MESSAGES_SQL}) AS m) AS a) AS b"""
)
def route_chat(spark, sf_dir):
    named = _messages(spark, sf_dir).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), "message", F.lit(None).cast("string").alias("contract_text"), F.col("given").alias("text"))
    return sessions.routed(sessions.session_context(named)).select(F.col("session_id").alias("conv_id"), F.col("ts").alias("turn"), "intent", "route")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS back FROM conversations QUALIFY back <= 6")
def session_history_last6(spark, sf_dir):
    return sessions.recent_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "back")


@query("SELECT conv_id, string_agg(concat_ws(': ', upper(role), text), chr(10) || '---' || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark, sf_dir):
    return sessions.transcript(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty_message' WHEN length(trim(text)) > 2000 THEN 'message_too_long' END AS problem FROM conversations")
def chat_guards(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chat_problem(F.col("text"), F.lit(None).cast("string")).alias("problem"))


# State ----------------------------------------------------------------------------------------------------------------

_GAPS_SQL = "SELECT user_id, ts, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS e"


@query(f"SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM ({_GAPS_SQL}) AS g GROUP BY user_id, s")
def user_sessions_30m(spark, sf_dir):
    return sessions.sessions(table(spark, sf_dir, "events"))


@query(f"SELECT user_id, event_id, s::INT AS session_no, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) = 1 AS created, least(row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id), 6)::INT AS n_messages FROM ({_GAPS_SQL.replace('SELECT user_id, ts,', 'SELECT user_id, event_id, ts,')}) AS g")
def session_states(spark, sf_dir):
    return sessions.session_states(table(spark, sf_dir, "events"))


@query("SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN true ELSE turn % 3 = 0 END AS use_preprocessing, CASE WHEN turn % 2 = 0 THEN false ELSE turn % 5 = 0 END AS use_hybrid, CASE WHEN trim(text) = '' THEN 'empty_text' END AS problem FROM conversations")
def raw_requests(spark, sf_dir):
    """Messages as requests; those of odd turns name their flags."""
    odd = F.col("turn") % 2 == 1
    asked = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("request_id"), "text", F.when(odd, F.col("turn") % 3 == 0).alias("use_preprocessing"), F.when(odd, F.col("turn") % 5 == 0).alias("use_hybrid"))
    return sessions.raw_requests(asked).select("request_id.*", "text", "use_preprocessing", "use_hybrid", "problem")


@query("SELECT event_id, CASE upper(event_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sessions.TASK_STATES.items()) + " ELSE 'pending' END AS shown, CASE WHEN event_id % 5 < 3 THEN (5 * 2 ** (event_id % 5))::INT END AS delay FROM (SELECT event_id, ['success', 'started', 'FAILURE', 'odd'][(event_id % 4 + 1)::INT] AS event_type FROM events) AS e")
def task_states(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ("success", "started", "FAILURE", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", sessions.shown_state(state).alias("shown"), sessions.retry_delay(F.col("event_id") % 5).alias("delay"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return sessions.tumbling(table(spark, sf_dir, "events"))


@query("SELECT window_start, event_type, count(*) AS n_events FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start, event_type FROM events) AS e GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    return sessions.sliding(table(spark, sf_dir, "events"))


_RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
    w AS (SELECT user_id, min(t) AS s FROM e GROUP BY user_id UNION ALL SELECT w.user_id, min(e.t) AS s FROM w JOIN e ON e.user_id = w.user_id AND e.t > w.s + 86400000000 GROUP BY w.user_id)
    SELECT user_id AS client, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) <= 2 AS allowed FROM (SELECT e.user_id, event_id, t, max(s) AS s FROM e JOIN w ON e.user_id = w.user_id AND w.s <= e.t GROUP BY e.user_id, event_id, t) AS x"""


@query(_RATE_SQL)
def rate_limit_decisions(spark, sf_dir):
    """Two requests a day per user: at the usual limit no user of the table is ever stopped."""
    return sessions.rate_decisions(table(spark, sf_dir, "events"), most=2, seconds=86400)


@query(_RATE_SQL)
def rate_limit_windows(spark, sf_dir):
    """The same by composed links, for clients of any size."""
    return rate.rate_windows(table(spark, sf_dir, "events"), most=2, seconds=86400)


@query("SELECT user_id AS task_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY user_id")
def task_latest_status(spark, sf_dir):
    return sessions.latest_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", F.col("event_type").alias("status")))


_UPLOADS_SQL = "SELECT o_custkey AS contract_id, concat('../in/file', CAST(o_orderkey % 7 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.exe' ELSE '.pdf' END) AS name, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 3) * 200 AS size, o_orderkey AS uploaded_at FROM orders"


def _uploads(spark, sf_dir):
    return spark.sql(_UPLOADS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"SELECT uploaded_at, concat(contract_id, '_', regexp_extract(name, '[^/]*$')) AS stored, CASE WHEN NOT regexp_matches(lower(name), '[.](pdf|docx)$') THEN 'bad_extension' WHEN size > 52428800 THEN 'too_large' WHEN size = 0 THEN 'empty' END AS problem FROM ({_UPLOADS_SQL}) AS u")
def upload_checks(spark, sf_dir):
    return _uploads(spark, sf_dir).select("uploaded_at", T.stored_name(F.col("contract_id").cast("string"), F.col("name")).alias("stored"), T.upload_problem(F.col("name"), F.col("size")).alias("problem"))


@query(f"SELECT contract_id, name, size, uploaded_at FROM ({_UPLOADS_SQL}) AS u QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY uploaded_at DESC, name DESC) = 1")
def contract_registry(spark, sf_dir):
    return sessions.registry(_uploads(spark, sf_dir))


# Training data checks and models --------------------------------------------------------------------------------------

_TUNING_LINES = (
    '{{"prompt": "Case {n}: explain the duty to deliver", "completion": "The seller must deliver the goods at the agreed place in good time and order."}}',
    '{{"prompt": "Under the Sales Act: who bears the risk in case {n}", "completion": {{"law": "Sales Act", "analysis": "risk passes with the goods unless the parties agree on something else"}}}}',
    '{{"prompt": "Under the Sales Act: who pays in case {n}", "completion": {{"law": "Lease Act", "analysis": "the buyer pays the price at the agreed time and place"}}}}',
    '{{"prompt": "A repeated   prompt", "completion": "The same question stands on many lines of this set, for a test."}}',
    '{{"prompt": "", "completion": "An answer without a question is of no use for any training run."}}',
    '{{"prompt": "What follows in case {n}?", "completion": ""}}',
    '{{"prompt": "A cheque was dishonoured in case {n}", "completion": "The drawer may be liable to the holder for the amount and some costs."}}',
    '{{"prompt": "Broken {n}, "completion": 3',
    '{{"prompt": "Short answer {n}", "completion": "It depends."}}',
    " ",
)
_TUNING_SQL = "SELECT conv_id * 100 + turn AS line_no, CASE (conv_id * 3 + turn) % 10 " + " ".join(f"WHEN {i} THEN concat('{before}', CAST(conv_id AS STRING), '{after}')" if n else f"WHEN {i} THEN '{before}'" for i, (before, n, after) in enumerate(x.replace("{{", "{").replace("}}", "}").partition("{n}") for x in _TUNING_LINES)) + " END AS raw FROM conversations"


def tuning_lines(spark, sf_dir):
    return spark.sql(_TUNING_SQL.replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))


@query(
    rf"""WITH l AS (SELECT line_no, raw, json_valid(raw) AS ok FROM ({_TUNING_SQL}) AS t WHERE trim(raw) <> ''),
    r AS (SELECT line_no, ok, coalesce(trim(CASE WHEN ok THEN json_extract_string(raw, '$.prompt') END), '') AS prompt, coalesce(trim(CASE WHEN ok THEN json_extract_string(raw, '$.completion') END), 'null') AS completion, nullif(trim(CASE WHEN ok THEN json_extract_string(raw, '$.completion.law') END), '') AS law FROM l),
    b AS (SELECT *, ok AND prompt <> '' AND completion <> '' AS has, lower(trim(regexp_replace(prompt, '\s+', ' ', 'g'))) AS norm FROM r),
    c AS (SELECT *, count(*) OVER (PARTITION BY has, norm) AS twins, min(line_no) OVER (PARTITION BY has, norm) AS first, lower(nullif(trim(regexp_extract(prompt, '(?i){rules.PROMPT_LAW}', 1)), '')) AS asked, lower(coalesce(law, completion)) AS actual FROM b)
    SELECT line_no, unnest(list_filter([CASE WHEN NOT ok THEN 'malformed_json' END, CASE WHEN ok AND prompt = '' THEN 'missing_prompt' END, CASE WHEN ok AND completion = '' THEN 'missing_completion' END, CASE WHEN has AND twins > 1 AND first = line_no THEN 'duplicate_prompt' END,
      CASE WHEN has AND asked <> lower(law) THEN 'law_mismatch' END, CASE WHEN has AND NOT contains(actual, lower(CASE {' '.join(f"WHEN regexp_matches(prompt, '(?i){p}') THEN {S.quote(law)}" for p, law in rules.LAW_HINTS)} END)) THEN 'scenario_law_suspicious' END,
      CASE WHEN has AND len(regexp_extract_all(completion, '\S+')) < 8 THEN 'short_completion' END], lambda x: x IS NOT NULL)) AS code FROM c"""
)
def dataset_issues(spark, sf_dir):
    return quality.dataset_issues(tuning_lines(spark, sf_dir))


@query(
    """WITH m AS (SELECT quality AS truth, toxic AS guess, count(*) AS n FROM labels GROUP BY 1, 2),
    t AS (SELECT truth AS label, sum(n) AS support, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS hits FROM m GROUP BY 1), g AS (SELECT guess AS label, sum(n) AS guessed FROM m GROUP BY 1),
    x AS (SELECT t.label, support, hits, CASE WHEN coalesce(guessed, 0) > 0 THEN hits / guessed ELSE 0 END AS p, hits / support AS r FROM t LEFT JOIN g ON t.label = g.label)
    SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 4) AS f1 FROM x"""
)
def label_metrics(spark, sf_dir):
    return learn.metrics(learn.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM labels")
def stratified_split(spark, sf_dir):
    return learn.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


@query()
def clause_classifier(spark, sf_dir):
    """A classifier trained on the rules' labels of four fifths of the corpus, and its metrics on the rest."""
    found = _ruled_corpus(spark, sf_dir).filter("label <> 'other'").select("doc_id", "text", "label", F.concat_ws("-", "doc_id", "para_idx").alias("key"))
    # A fit reads its rows again and again: neither rules nor ranks are computed more than once.
    rows = _written(learn.stratified_split(found, "key", "label"), "split")
    predict = learn.train(rows.filter("split = 'train'").select("text", "label"))
    return learn.metrics(learn.confusion(predict(rows.filter("split = 'test'").select("doc_id", "text", "label")), "label", "ml_label"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10000")
def tuning_order(spark, sf_dir):
    return quality.shuffled_first(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


# Small dimensions -----------------------------------------------------------------------------------------------------

_CARDS = "(VALUES " + ", ".join("(" + ", ".join(map(S.quote, (*c, rules.ANSWERS[c[0]]))) + ")" for c in rules.LANDMARKS) + ") AS cards(id, region, tag, title, citation, summary)"


@query(f"SELECT id, title FROM {_CARDS} WHERE contains(lower(concat(title, '|', citation, '|', tag, '|', summary, '|', region)), 'constitution')")
def landmark_search(spark, sf_dir):
    return sessions.search_landmarks(sessions.landmark_cards(spark), "Constitution").select("id", "title")


#: What a message of a conversation is taken to ask for, by its length.
_ASKED = ("Constitution", "carlill", "PROPERTY", " 1980 ", "field: contract", "no such case", "personal liberty", " ")
_CARD_COLUMNS = "(VALUES " + ", ".join("(" + ", ".join(map(S.quote, (c[0], *(x.lower() for x in (*c[1:], rules.ANSWERS[c[0]], sessions.details(c)))))) + ")" for c in rules.LANDMARKS) + ") AS cards(id, region, tag, title, citation, summary, details)"


@query(
    f"""SELECT conv_id, turn, count(id) AS n_hits, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM (SELECT conv_id, turn, lower(trim(([{', '.join(map(S.quote, _ASKED))}])[(length(coalesce(text, '')) % {len(_ASKED)} + 1)::INT])) AS q FROM conversations WHERE role = 'user') AS m
    LEFT JOIN {_CARD_COLUMNS} ON q <> '' AND (contains(region, q) OR contains(tag, q) OR contains(title, q) OR contains(citation, q) OR contains(summary, q) OR contains(details, q)) GROUP BY conv_id, turn"""
)
def landmark_hits(spark, sf_dir):
    """The search of the landmark cards for every message of a user."""
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), F.length(F.coalesce("text", F.lit(""))) % len(_ASKED) + 1)
    found = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_sort(sessions.landmarks_found(asked)).alias("ids"))
    return found.select("conv_id", "turn", F.size("ids").cast("long").alias("n_hits"), F.array_join("ids", ",").alias("ids"))


@query(
    f"""SELECT doc_id, para_idx, rule_ord, category, severity, matched_phrase FROM ({S.risk_matches().replace(S.risk_rules(), '(SELECT * FROM ' + S.risk_rules() + f" WHERE category <> 'Penalty Clauses' UNION ALL SELECT {len(rules.RISK_RULES)}, 'Season', 'LOW', x.i, x.k FROM (VALUES (0, 'harvest'), (1, 'valley')) AS x(i, k)) AS rules")}) AS m"""
)
def custom_risk_rules(spark, sf_dir):
    """One category off, one rule of our own more."""
    own = risk.add_rule(risk.disable_category(risk.rule_table(spark), "Penalty Clauses"), "Season", "LOW", ["harvest", "valley"])
    return risk.risk_matches(corpus(spark, sf_dir), own).select("doc_id", "para_idx", "rule_ord", "category", "severity", "matched_phrase")


_LABEL_IDS = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(rules.MODEL_LABELS))


@query(f"SELECT doc_id, para_idx, label, (CASE label {_LABEL_IDS} END)::INT AS label_id FROM ({S.decided(CORPUS_SQL)}) AS d WHERE label IN ({', '.join(map(S.quote, rules.MODEL_LABELS))}) AND {S.strip('text')} <> ''")
def label_ids(spark, sf_dir):
    """Training rows: known labels by number, blank paragraphs left out."""
    found = classify.detect_clauses(corpus(spark, sf_dir))
    known = learn.labelled_paragraphs(found.filter(F.col("label").isin(*rules.MODEL_LABELS)))
    return learn.encode_labels(known).select("doc_id", "para_idx", "label", "label_id")


_ANSWERS = " ".join(f"WHEN {S.quote(k)} THEN {S.quote(a)}" for k, a in rules.ANSWERS.items())


@query(f"SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'remote ' || turn ELSE coalesce(CASE k {_ANSWERS} END, {S.quote(rules.FALLBACK_ANSWER)}) END AS response FROM (SELECT conv_id, turn, {S.first_match('message', rules.KNOWLEDGE_PATTERNS + rules.RESPONDER_PATTERNS)} AS k FROM ({_MESSAGES_SQL}) AS m) AS a")
def remote_answers(spark, sf_dir):
    """A remote responder that knows every fifth conversation; the stored answers stand in for the rest."""
    asked = _messages(spark, sf_dir).withColumn("message_id", F.struct("conv_id", "turn"))
    remote = lambda m: m.select("message_id", F.when(F.col("message_id.conv_id") % 5 == 0, F.concat(F.lit("remote "), F.col("message_id.turn").cast("string"))).alias("remote_response"))
    return classify.answered(asked.select("message_id", "message"), remote).select("message_id.conv_id", "message_id.turn", "response")


@query("SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey % 2000 THEN 'same_contract' WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 'unknown_contract' END AS problem FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_orderkey % 2000 = b.c_custkey")
def compare_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id_a"), (F.col("o_orderkey") % 2000).alias("id_b"))
    return match.comparable(asked, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"))).select("o_orderkey", "problem")


@query(f"SELECT o_orderkey, o_custkey + o_orderkey % 2 * 1000000 AS contract_id, md5(text) AS digest FROM orders LEFT JOIN ({_JOINED_SQL}) AS j ON o_custkey + o_orderkey % 2 * 1000000 = j.doc_id")
def contract_texts(spark, sf_dir):
    """Texts by contract id; half of the requests name none that is known."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("contract_id"))
    known = joined(corpus(spark, sf_dir)).withColumnRenamed("doc_id", "contract_id")
    return sessions.contract_text(asked, known).select("o_orderkey", "contract_id", F.md5("text").alias("digest"))


@query("SELECT to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type})::VARCHAR AS value FROM events")
def event_log(spark, sf_dir):
    return sessions.event_log(table(spark, sf_dir, "events"), ["event_id", "user_id", "event_type"])


@query("SELECT a.conv_id, a.turn, '### Instruction:' || chr(10) || a.text || chr(10) || chr(10) || '### Response:' || chr(10) || b.text AS training_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def tuning_prompts(spark, sf_dir):
    """Each question with the answer that follows, as a training prompt."""
    said = table(spark, sf_dir, "conversations")
    asked = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return quality.prompt_text(asked.join(answers, ["conv_id", "turn"])).select("conv_id", "turn", "training_text")


@query(f"SELECT line_no, json_valid(raw) AS good, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.prompt') END AS prompt FROM ({_TUNING_SQL}) AS t WHERE trim(raw) <> ''")
def jsonl_rows(spark, sf_dir):
    return files.parsed_jsonl(tuning_lines(spark, sf_dir).withColumnRenamed("raw", "value")).select("line_no", "good", "prompt")


@query("SELECT path, page_no, CASE WHEN abs(median(angle)) >= 0.5 THEN median(angle) ELSE 0.0 END AS angle FROM (SELECT user_id AS path, (event_id % 2)::INT AS page_no, value - 10 AS angle, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM events) AS e WHERE n <= 50 GROUP BY path, page_no")
def page_angles(spark, sf_dir):
    """Event values stand in for the angles of a page's lines."""
    angles = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), (F.col("event_id") % 2).cast("int").alias("page_no"), F.col("event_id").alias("line_no"), (F.col("value") - 10).alias("angle"))
    return files.median_angle(angles)


@query("SELECT o_orderkey, 'SALE AGREEMENT between ' || coalesce(nullif(trim(c_name), ''), '[Party A]') || ' and [Party B], effective [Date]. Goods: [Goods]. Price: ' || floor(o_totalprice)::BIGINT || '.' AS draft FROM orders JOIN customer ON o_custkey = c_custkey")
def draft_render(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    filled = rows.select("o_orderkey", F.col("c_name").alias("party_a"), F.floor("o_totalprice").cast("long").alias("amount"), F.lit(" ").alias("goods"))
    return drafts.drafts(filled, "sale").select("o_orderkey", "draft")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk report of every contract with its number of clauses of each class found."""
    found = classify.detect_clauses(corpus(spark, sf_dir))
    n_types = found.filter("label <> 'other'").groupBy("doc_id").agg(F.countDistinct("label").alias("n_clause_types"))
    return risk_report(spark, sf_dir).join(n_types, "doc_id", "left")


#: Words of a drawn page, and those from which on its angle must be found.
_PAGE_WORDS, _ENOUGH_WORDS = 120, 60


@query(
    f"""SELECT doc_id, page_no::INT AS page_no, n_words::INT AS n_words, drawn, CASE WHEN n_words >= {_ENOUGH_WORDS} THEN true END AS found FROM (
    SELECT doc_id, page_no, least({_PAGE_WORDS}, n - page_no * {_PAGE_WORDS}) AS n_words, ((doc_id * 7 + page_no * 3) % 41 - 20) / 2.0::DOUBLE AS drawn FROM (
    SELECT doc_id, n, unnest(range(0, (n + {_PAGE_WORDS - 1}) // {_PAGE_WORDS})) AS page_no FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM ({_JOINED_SQL}) AS j) AS d) AS p) AS q"""
)
def image_line_angles(spark, sf_dir):
    """Every contract drawn as pages at known angles, cleaned, and its lines' angles found again within half a degree."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.length)
    docs = joined(corpus(spark, sf_dir)).select("doc_id", words.alias("w"))
    numbered = docs.filter(F.size("w") > 0).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / _PAGE_WORDS).cast("int"))).alias("page_no"))
    pages = numbered.select(F.col("doc_id").cast("string").alias("path"), "doc_id", "page_no", F.slice("w", F.col("page_no") * _PAGE_WORDS + 1, _PAGE_WORDS).alias("w"), (((F.col("doc_id") * 7 + F.col("page_no") * 3) % 41 - 20) / 2.0).alias("drawn"))

    def draw(batches):
        # A batch of ten thousand rows of numbers would be 0.8 GB of pictures.
        for batch in batches:
            for part in (batch.iloc[i : i + 100] for i in range(0, len(batch), 100)):
                yield part[["path", "page_no"]].assign(content=[images.drawn_page(list(w), a, int(i)) for w, a, i in zip(part["w"], part["drawn"], part["doc_id"])])

    # Lengths of words move, pictures do not. The number is given, or so little would be joined to one task.
    pages = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "page_no")
    cleaned = files.cleaned_images(pages.mapInPandas(draw, "path string, page_no int, content binary"), images.STEPS, off=("deskew",))
    angles = files.median_angle(images.angles_of(cleaned))
    known = pages.select("path", "page_no", "doc_id", F.size("w").alias("n_words"), "drawn")
    both = known.join(angles, ["path", "page_no"], "left")
    return both.select("doc_id", "page_no", "n_words", "drawn", F.when(F.col("n_words") >= _ENOUGH_WORDS, F.coalesce(F.abs(F.col("angle") - F.col("drawn")) <= 0.5, F.lit(False))).alias("found"))
