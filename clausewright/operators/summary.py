"""Summaries: sections by rules, extractive chunk summaries, key points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.functions import text as T
from clausewright.operators.segment import let, overlap_chunks, overlap_words

PER_SECTION, KEY_POINTS = 8, 8


def sentences_of(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, sentence) of the cleaned text."""
    return docs.select("doc_id", F.posexplode(T.sentences(T.clean_summary(F.col("text")))).alias("sentence_no", "sentence"))


def sections(found: DataFrame, most: int = PER_SECTION) -> DataFrame:
    """(doc_id, section, position, sentence). The first `most` sentences of more than five words per section are
    taken, repeated ones counting; only then are repeats dropped."""
    low = F.lower("sentence")
    tagged = found.filter(T.word_total(F.col("sentence")) > 5).select("doc_id", "sentence_no", "sentence", F.explode(F.filter(F.array(*(F.when(low.rlike(p), F.lit(s)) for s, p in rules.SECTION_PATTERNS.items())), lambda s: s.isNotNull())).alias("section"))
    first = tagged.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("sentence_no"))).filter(F.col("n") <= most)
    unique = first.groupBy("doc_id", "section", "sentence").agg(F.min("n").alias("n"))
    return unique.select("doc_id", "section", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("n")).alias("position"), "sentence")


def leading(own: Column, words: int = 80) -> Column:
    """The first of a chunk's words as a text, marked if any are left out."""
    return F.when(F.size(own) > words, F.concat(F.array_join(F.slice(own, 1, words), " "), F.lit(" …"))).otherwise(F.array_join(own, " "))


def lead(chunk: Column, words: int = 80) -> Column:
    """S4's default: the first words, marked if any are left out."""
    return let(T.words(chunk), lambda own: leading(own, words))


def combined(parts: Column, second_pass=None, most: int = 200) -> Column:
    """Nothing, the one summary, or all joined; beyond `most` words a second pass if there is one."""

    def whole(own: Column) -> Column:
        joined = F.array_join(own, " ")
        several = joined if second_pass is None else F.when(T.word_total(joined) <= most, joined).otherwise(second_pass(joined))
        return F.when(F.size(own) == 0, "").when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(several)

    # A model's function cannot stand inside a lambda; nothing else needs the parts twice.
    kept = F.filter(F.transform(parts, T.strip), lambda p: p != "")
    return let(kept, whole) if second_pass is None else whole(kept)


SECTION_FIELDS = {"obligations": "obligations", "payment": "payment_terms", "termination": "termination", "risk": "risks"}


#: Words of the section patterns, which are alternatives without any other sign: looking for each needs no expression.
SECTION_WORDS = {name: pattern.split("|") for name, pattern in rules.SECTION_PATTERNS.items()}


def sections_within(found: Column, words: Column, most: int = PER_SECTION) -> Column:
    """S1 within one text: the array of its sentences, with the words of each, to a struct of one array per section, as
    sections() gives them. What is asked of a sentence is computed once."""
    named = F.zip_with(found, words, lambda s, own: F.when(F.size(own) > 5, F.struct(s.alias("s"), F.lower(s).alias("low"))))
    long = F.filter(named, lambda x: x.isNotNull())
    held = lambda low, asked: reduce(lambda a, b: a | b, (low.contains(w) for w in asked))
    of = lambda kept, asked: F.array_distinct(F.slice(F.filter(kept, lambda x: held(x["low"], asked)).getField("s"), 1, most))
    return let(long, lambda kept: F.struct(*(of(kept, asked).alias(SECTION_FIELDS[name]) for name, asked in SECTION_WORDS.items())))


def summarise(docs: DataFrame, summarise_chunk=lead, second_pass=None, limit: int = 700, summarise_chunks=None) -> DataFrame:
    """(doc_id, overall_summary, key_points, obligations, payment_terms, termination, risks). Blank texts give
    no row, as they are an error in a single call. summarise_chunk: column to column, of built-in functions;
    summarise_chunks: rows (doc_id, text, _chunks) to the same with _parts, the chunks' summaries, such as central_parts
    or a model over batches. Nothing leaves its row."""
    real = docs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    if summarise_chunks:
        real = summarise_chunks(real.select("doc_id", "text", overlap_chunks(F.col("text"), limit).alias("_chunks")))
    # A chunk's words are at hand for the default, which would only split them again.
    short = lambda own: leading(own) if summarise_chunk is lead else summarise_chunk(F.array_join(own, " "))
    parts_of = lambda words: F.col("_parts") if summarise_chunks else F.transform(overlap_words(words, limit), short)
    both = lambda found, words: F.struct(sections_within(found, words).alias("sections"), parts_of(words).alias("parts"))
    # Sentences and their words serve sections and chunks; within lambdas they are found once and written nowhere.
    told = let(T.sentences(T.clean_summary(F.col("text"))), lambda found: let(F.transform(found, T.clean_words), lambda words: both(found, words)))
    told = real.select("doc_id", told.alias("_told"))
    chunked = told.select("doc_id", F.col("_told.sections").alias("_sections"), combined(F.col("_told.parts"), second_pass).alias("overall_summary"))
    points = lambda text: F.slice(F.filter(T.sentences(text), lambda s: T.word_total(s) > 6), 1, KEY_POINTS)
    found = let(F.col("overall_summary"), lambda text: let(points(text), lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(text))))
    return chunked.select("doc_id", "overall_summary", found.alias("key_points"), *(F.col(f"_sections.{c}") for c in SECTION_FIELDS.values()))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken between words; a longer word is a line of its own."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, word: Column) -> Column:
        fits = (acc["n"] > 0) & (acc["n"] + 1 + F.length(word) <= width)
        gap = F.when(acc["n"] == 0, "").when(fits, " ").otherwise("\n")
        return F.struct(F.concat(acc["out"], gap, word).alias("out"), F.when(fits, acc["n"] + 1 + F.length(word)).otherwise(F.length(word)).alias("n"))

    return F.aggregate(T.words(text), start, step, lambda acc: acc["out"])


def summary_text(summaries: DataFrame, width: int = 100) -> DataFrame:
    """SK5: a plain text report per document, its summary wrapped."""
    bullets = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.lit("  - "), s)), "\n")
    heads = (("Key points", "key_points"), ("Obligations", "obligations"), ("Payment terms", "payment_terms"), ("Termination", "termination"), ("Risks", "risks"))
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{h}\n"), bullets(F.col(c)))) for h, c in heads]
    return summaries.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("Summary\n"), wrapped(F.col("overall_summary"), width)), *parts).alias("report"))


PLAIN_PROMPT = "Explain this contract summary briefly and simply, for someone who is no lawyer:\n"


def plain_words(summary: Column, sentences: int = 2) -> Column:
    """S8's default: the first sentences, after a note on what they are."""
    first = F.slice(T.sentences(summary), 1, sentences)
    return F.when(F.size(first) > 0, F.concat(F.lit("In short: "), F.array_join(first, " "))).otherwise(F.lit(""))


def explained(summaries: DataFrame, explain=None) -> DataFrame:
    """The summary service's rows: (doc_id, summary, key_points, prompt, explanation). A blank overall summary gives
    way to the joined key points. explain: column of prompts to column of answers, such as a pandas UDF over a model; the
    default needs none."""
    text = F.when(T.strip(F.col("overall_summary")) != "", F.col("overall_summary")).otherwise(F.array_join("key_points", " "))
    named = summaries.select("doc_id", text.alias("summary"), "key_points").withColumn("prompt", F.concat(F.lit(PLAIN_PROMPT), "summary"))
    return named.withColumn("explanation", explain(F.col("prompt")) if explain else plain_words(F.col("summary")))


def summary_message(rows: DataFrame) -> DataFrame:
    """SK9's summary form: explained() rows as one display text each: the summary, the key points as a list, and the
    plain-language part; parts without content are left out."""
    points = F.when(F.size("key_points") > 0, F.concat(F.lit("\n**Key points**\n"), F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("- "), p)), "\n")))
    plain = F.when(T.strip(F.col("explanation")) != "", F.concat(F.lit("\n**In plain language**\n"), T.strip(F.col("explanation"))))
    return rows.select("doc_id", F.concat_ws("\n", F.nullif(T.strip(F.col("summary")), F.lit("")), points, plain).alias("message"))
