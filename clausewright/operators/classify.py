"""Clause classification: rule counts compiled to one projection, argmax by class order, hybrid decision, clause map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.functions import text as T
from clausewright.operators.segment import clause_chunks

CLASSES = tuple(rules.CLAUSE_PATTERNS)
#: Java flags under which the rules match as they are meant: any case, Unicode words, line ends only at \n.
FLAGS = "(?iUd)"


def folded(text: Column) -> Column:
    """Lower case with the letters that match s and i in any case, for the literal test."""
    return F.lower(F.translate(text, "ſıİ", "sii"))


def rule_count(text: Column, low: Column, pattern: str) -> Column:
    """Matches of one rule. A literal that every match holds is looked for first: most paragraphs stop there. Where a match
    may begin is told by its first letter before the costlier test for the start of a word."""
    first = rules.first_word(pattern)[:1]
    count = F.regexp_count(text, F.lit(FLAGS + (f"(?={first})" if first else "") + pattern))
    literal = rules.required_literal(pattern)
    return F.when(low.contains(literal), count).otherwise(0) if literal else count


def starts_pattern(starts: list[str]) -> str:
    """An expression for any of the given starts at the start of a word, by first letter, so that few are tried."""
    letters = sorted({x[0] for x in starts})
    return "(?<![a-z])(?:" + "|".join(f"{a}(?:{'|'.join(sorted(x[1:] for x in starts if x[0] == a))})" for a in letters) + ")"


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that later filters refer to as they are. They pass through a generator of one row: a plain
    projection would be copied, with all its rules, into every filter on a label, and planning would take minutes."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return rows.select("*", made.alias("_made")).select(*rows.columns, "_made.*")


def clause_scores(paragraphs: DataFrame, patterns: dict[str, tuple[str, ...]] = rules.CLAUSE_PATTERNS) -> DataFrame:
    """C1's counts: paragraphs with one column score_<class> each. Wide, so that no paragraph is joined to 145 rules. The
    starts of words with which rules begin are found in one pass; only classes and rules whose start is among them are
    asked. A null text scores 0."""
    low = F.col("_low")
    own = {p: rules.first_word(p) for ps in patterns.values() for p in ps}
    starts = rules.shortest_starts([w for w in own.values() if w])
    found = F.regexp_extract_all(low, F.lit(starts_pattern(sorted(set(starts.values())))), F.lit(0)) if starts else F.array().cast("array<string>")

    def asked(k: Column, pattern: str) -> Column:
        count = rule_count(F.col("text"), low, pattern)
        return F.when(F.array_contains(k, starts[own[pattern]]), count).otherwise(0) if own[pattern] else count

    def score(k: Column, ps: tuple[str, ...]) -> Column:
        total = reduce(lambda a, b: a + b, (asked(k, p) for p in ps))
        some = F.arrays_overlap(k, F.array(*map(F.lit, sorted({starts[own[p]] for p in ps if own[p]})))) if all(own[p] for p in ps) else F.lit(True)
        return F.coalesce(F.when(some, total), F.lit(0))

    # Within a lambda, so that the rules are never one method too large to be compiled, and stand behind a generator.
    made = F.explode(F.transform(F.array(found), lambda k: F.struct(*(score(k, ps).alias(f"score_{c}") for c, ps in patterns.items()))))
    return paragraphs.withColumn("_low", folded(F.col("text"))).select(*paragraphs.columns, made.alias("_made")).select(*paragraphs.columns, "_made.*")


def decided(scored: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """C1's decision: label (the first class with the most matches, or other) and confidence (its share, 4 places)."""
    columns = [F.col(f"score_{c}") for c in classes]
    total, best = reduce(lambda a, b: a + b, columns), F.greatest(*columns)
    label = reduce(lambda rest, c: F.when(F.col(f"score_{c}") == F.col("best_score"), c).otherwise(rest), reversed(classes), F.lit("other"))
    confidence = F.when(F.col("total_score") > 0, F.round(F.col("best_score") / F.col("total_score"), 4)).otherwise(0.0)
    measured = computed(scored, {"total_score": total, "best_score": best})
    return computed(measured, {"label": F.when(F.col("total_score") > 0, label).otherwise("other"), "confidence": confidence})


def detect_clauses(paragraphs: DataFrame) -> DataFrame:
    """(…, label, confidence) for each paragraph."""
    return decided(clause_scores(paragraphs)).drop(*(f"score_{c}" for c in CLASSES), "best_score", "total_score")


def detect_enhanced(paragraphs: DataFrame) -> DataFrame:
    """C4: the same with is_heading and scores_per_class; a heading's confidence above 0.3 is raised by a fifth."""
    scored = decided(clause_scores(paragraphs)).withColumn("is_heading", T.is_heading(F.col("text")))
    raw = F.col("best_score") / F.col("total_score")
    boosted = F.when(F.col("is_heading") & (raw > 0.3), F.least(F.lit(1.0), raw * 1.2)).otherwise(raw)
    scores = F.create_map(*(x for c in CLASSES for x in (F.lit(c), F.col(f"score_{c}"))))
    confidence = F.when(F.col("total_score") > 0, F.round(boosted, 4)).otherwise(0.0)
    return scored.withColumn("confidence", confidence).withColumn("scores_per_class", scores).drop(*(f"score_{c}" for c in CLASSES), "best_score", "total_score")


def scores_long(scored: DataFrame, keys: tuple[str, ...] = ("doc_id", "para_idx")) -> DataFrame:
    """One row per paragraph and class that scored."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("clause_class"), F.col(f"score_{c}").alias("score")) for c in CLASSES)))
    return scored.select(*keys, stacked.alias("x")).select(*keys, "x.clause_class", "x.score").filter("score > 0")


def structured(paragraphs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Detections of paragraphs that aren't blank, with page numbers where there are any."""
    found = detect_enhanced(paragraphs.filter(T.strip(F.col("text")) != "")).withColumnRenamed("label", "clause_type")
    if pages is None:
        return found.withColumn("page_number", F.lit(None).cast("int"))
    return found.join(pages.select("doc_id", "para_idx", "page_number"), ["doc_id", "para_idx"], "left")


def grouped(found: DataFrame) -> DataFrame:
    """Clauses of a document by type, in order."""
    return found.groupBy("doc_id", "clause_type").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text", "confidence"))).alias("clauses"))


def judged(both: DataFrame, threshold: float) -> DataFrame:
    """C7's decision on rows with label, confidence, ml_label and ml_confidence."""
    sure, surer = F.col("confidence") >= threshold, F.coalesce(F.col("ml_confidence"), F.lit(0.0)) > F.col("confidence")
    return both.select(
        "doc_id",
        "para_idx",
        F.when(~sure & surer, F.col("ml_label")).otherwise(F.col("label")).alias("label"),
        F.when(~sure & surer, F.col("ml_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(sure, "rule_based").when(surer, "ml_fallback").otherwise("rule_based_low_confidence").alias("method"),
        F.col("confidence").alias("rule_confidence"),
        F.when(~sure, F.col("ml_confidence")).alias("ml_confidence"),
    )


def hybrid(ruled: DataFrame, learned: DataFrame, threshold: float = 0.75) -> DataFrame:
    """A sure rule decides; else the model, if it is surer than the rule. ruled: keys, label, confidence;
    learned: keys, ml_label, ml_confidence. Keyed, so blanks never shift results."""
    return judged(ruled.join(learned, ["doc_id", "para_idx"], "left"), threshold)


def cascade(ruled: DataFrame, model, threshold: float = 0.75) -> DataFrame:
    """C7 with a costly model: only paragraphs whose rule is unsure reach `model`, which adds ml_label and ml_confidence
    to the rows it is given. The split is a plan, not a condition: a Python function inside WHEN would run for every
    row. Nothing is joined."""
    unsure, sure = ruled.filter(F.col("confidence") < threshold), ruled.filter(F.col("confidence") >= threshold)
    unasked = sure.withColumn("ml_label", F.lit(None).cast("string")).withColumn("ml_confidence", F.lit(None).cast("double"))
    return judged(unasked, threshold).unionByName(judged(model(unsure), threshold))


def prediction(label: Column, score: Column) -> Column:
    """A prediction as callers get it: (clause_type, confidence to 4 places)."""
    return F.struct(label.alias("clause_type"), F.round(score.cast("double"), 4).alias("confidence"))


def statistics(found: DataFrame, label: str = "label") -> DataFrame:
    """Paragraphs and mean confidence per class."""
    return found.groupBy(label).agg(F.count(F.lit(1)).alias("clause_count"), F.round(F.avg("confidence"), 4).alias("average_confidence"))


def representatives(found: DataFrame) -> DataFrame:
    """The first paragraph of each class but other, per document."""
    return found.filter("label <> 'other'").groupBy("doc_id", "label").agg(F.min_by("text", "para_idx").alias("text"), F.min("para_idx").alias("para_idx"))


def clause_map(docs: DataFrame, most_snippet: int = 200) -> DataFrame:
    """The clause map in detail: (doc_id, para_idx, clause_type, label, confidence, snippet) of each chunk."""
    chunks = docs.select("doc_id", F.posexplode(clause_chunks(F.col("text"))).alias("para_idx", "text"))
    found = detect_clauses(chunks)
    return found.select("doc_id", "para_idx", F.col("label").alias("clause_type"), T.type_label(F.col("label")).alias("label"), "confidence", T.snippet(F.col("text"), most_snippet).alias("snippet"))


def clause_map_summary(mapped: DataFrame) -> DataFrame:
    """Its groups per document: type, display name, count, mean confidence, and rank by count, ties by first chunk (O2)."""
    groups = mapped.groupBy("doc_id", "clause_type", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.min("para_idx").alias("first_idx"))
    return groups.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_idx")))


def with_fallback(learned: DataFrame, ruled: DataFrame) -> DataFrame:
    """A model that finds nothing in a whole document (only `other` at 0) gives way to the rules, with a note."""
    useless = learned.groupBy("doc_id").agg(F.bool_and((F.col("label") == "other") & (F.col("confidence") == 0)).alias("useless"))
    kept = learned.join(useless.filter("NOT useless"), "doc_id", "left_semi").withColumn("classifier", F.lit("model"))
    instead = ruled.join(useless.filter("useless"), "doc_id", "left_semi").withColumn("classifier", F.lit("rules"))
    return kept.unionByName(instead)


def accept(label: Column, score: Column, least: float = 0.30) -> Column:
    """An unsure model's label becomes other; the score stays."""
    return F.when(score < least, "other").otherwise(label)


def first_match(text: Column, entries: tuple[tuple[str, str], ...]) -> Column:
    """Key of the first pattern that the text matches, or null; tried in order and no further than needed."""
    return reduce(lambda rest, e: F.when(text.rlike(FLAGS + e[1]), e[0]).otherwise(rest), reversed(entries), F.lit(None).cast("string"))


def intent(message: Column) -> tuple[Column, Column]:
    """(intent, confidence). Blank messages are GENERAL for sure; unmatched ones GENERAL at 0.5."""
    found, blank = first_match(message, rules.INTENT_PATTERNS), T.strip(F.coalesce(message, F.lit(""))) == ""
    return F.when(blank, "GENERAL").otherwise(F.coalesce(found, F.lit("GENERAL"))), F.when(blank | found.isNotNull(), 1.0).otherwise(0.5)


def keyword_intent(message: Column) -> Column:
    """C21."""
    low = F.lower(message)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return reduce(lambda rest, e: F.when(any_of(e[1]), e[0]).otherwise(rest), reversed(rules.KEYWORD_INTENTS), F.lit("GENERAL"))


def answer_key(message: Column, responder: bool = False) -> Column:
    """Key of the stored answer; responder adds the further patterns. Null: the fallback."""
    found = first_match(message, rules.KNOWLEDGE_PATTERNS)
    return F.coalesce(found, first_match(message, rules.RESPONDER_PATTERNS)) if responder else found


def answer(message: Column, responder: bool = False) -> Column:
    answers = F.create_map(*(F.lit(x) for pair in rules.ANSWERS.items() for x in pair))
    return F.coalesce(F.element_at(answers, answer_key(message, responder)), F.lit(rules.FALLBACK_ANSWER))


def answered(messages: DataFrame, remote=None) -> DataFrame:
    """Messages with `response`. remote, if given, maps (message_id, message) to (message_id, remote_response); a
    null one falls back to the stored answers."""
    local = messages.withColumn("response", answer(F.col("message"), responder=True))
    if remote is None:
        return local
    return local.join(remote(messages.select("message_id", "message")), "message_id", "left").withColumn("response", F.coalesce("remote_response", "response")).drop("remote_response")
