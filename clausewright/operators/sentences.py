"""G19, trained: sentence boundaries learned from a corpus without labels.

Abbreviations, collocations across a period, and words that begin sentences are found by log-likelihood ratios over corpus
counts (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection", 2006); then one pass over each text
asks for the few places that those leave open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators.segment import let
from clausewright.sources.shared import cut

#: Thresholds of the paper: scores of abbreviations, ratios of collocations and of sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Rows of a model table that are sent to every task; a larger one is joined by key.
SMALL = 100_000
BLANK = r"[ \t\n\f\r]"


def tokens(text: Column) -> Column:
    """Runs of what isn't blank, each with the blanks behind it; blanks before the first are none's."""
    return F.regexp_extract_all(text, F.lit(r"([^ \t\n\f\r]+[ \t\n\f\r]*)"), F.lit(1))


_ENDS = r"[.!?]$"


def _core(token: Column) -> Column:
    """A token without blanks, quotes and brackets at its ends."""
    return F.regexp_replace(F.regexp_replace(token, f"{BLANK}+$", ""), r"^[\"'(\[{]+|[\"')\]}]+$", "")


def _known(token: Column) -> Column:
    """What is asked of a token: its word (lower case; numbers are `##`), how it ends, and how it begins."""

    def of(c: Column) -> Column:
        word = F.lower(F.regexp_replace(c, r"[.,;:!?]+$", ""))
        return F.struct(
            F.when(word.rlike(r"^[0-9][0-9.,/-]*$"), "##").otherwise(word).alias("word"),
            c.rlike(r"[^.!?]\.$").alias("stop"),
            c.rlike(_ENDS).alias("ends"),
            c.rlike(r"[!?]$").alias("loud"),
            c.rlike(r"^\p{Lu}").alias("upper"),
            c.rlike(r"^\p{Ll}").alias("lower"),
        )

    return let(_core(token), of)


def _may_end(token: Column) -> Column:
    """Whether a token holds a mark that can end a sentence; most hold none, and nothing further is asked of those."""
    return token.contains(".") | token.contains("!") | token.contains("?")


def marked(docs: DataFrame) -> DataFrame:
    """docs with `_tokens`, and `_marks`: of each token that can end a sentence and has one behind it, its place (`at`) and
    what is asked of it and of the next."""
    found = docs.withColumn("_tokens", tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    places = F.transform("_tokens", lambda x, i: F.when(_may_end(x), F.struct(i.alias("at"), x.alias("token"), F.get("_tokens", i + 1).alias("next"))))

    def asked(x: Column) -> Column:
        both = F.array(F.struct(_known(x["token"]).alias("t"), _known(x["next"]).alias("n")))
        return F.get(F.transform(both, lambda y: F.struct(x["at"].alias("at"), *(y["t"][c].alias(c) for c in ("word", "stop", "ends", "loud")), y["n"]["word"].alias("next"), y["n"]["upper"].alias("next_upper"), y["n"]["lower"].alias("next_lower"))), F.lit(0))

    return found.withColumn("_marks", F.transform(F.filter(places, lambda x: x["next"].isNotNull()), asked))


def counted(docs: DataFrame) -> DataFrame:
    """(token, within, next, n): tokens of all texts without their blanks, by whether they stand within a sentence, and the
    token after those that hold a period. Equal ones are counted before they move, and only then is asked what they are."""
    bare = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"([^ \t\n\f\r]+)"), F.lit(1))
    beside = lambda own: F.transform(own, lambda x, i: F.struct(x.alias("token"), F.get(own, i - 1).alias("prior"), F.when(x.contains("."), F.get(own, i + 1)).alias("next")))
    # Outer, as a plain explode would be preceded by a filter that computes all of its array once more.
    each = docs.select(F.explode_outer(let(bare, beside)).alias("t")).select("t.*").filter("token IS NOT NULL")
    within = F.when(F.col("prior").isNull(), False).when(_may_end(F.col("prior")), ~_core(F.col("prior")).rlike(_ENDS)).otherwise(True)
    return each.groupBy("token", within.alias("within"), "next").agg(F.count(F.lit(1)).alias("n"))


def _ratio(k: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of k common occurrences of what occurs n1 and n2 times among n."""
    part = lambda count, p: F.when(count > 0, count * F.ln(F.when(count > 0, p))).otherwise(0.0)
    like = lambda k, n, p: part(k, p) + part(n - k, 1 - p)
    share, inside, outside = F.try_divide(n2, n), F.try_divide(k, n1), F.coalesce(F.try_divide(n2 - k, n - n1), F.lit(0.0))
    return 2 * (like(k, n1, inside) + like(n2 - k, n - n1, outside) - like(k, n1, share) - like(n2 - k, n - n1, share))


@dataclass
class Model:
    """What a corpus says: word counts, abbreviations (word, score), collocations (word, next), starters (word)."""

    words: DataFrame
    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame


def has_letter(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{L}$")


def train(docs: DataFrame) -> Model:
    """The model of all texts of docs (text). Counts are aggregated before they move; only four totals reach the driver.
    Null texts are empty; an empty corpus has an empty model, by which every period ends a sentence."""
    held = cut(counted(docs.select("text")))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    bare = held.groupBy("token", "within").agg(F.sum("n").alias("n"))
    # What is asked of a token passes through a generator of one row: each column and filter would ask it again.
    each = bare.select(F.explode(F.array(_known(F.col("token")))).alias("t"), "within", "n").select("t.*", "within", "n").filter("word <> ''")
    words = cut(each.groupBy("word").agg(F.sum("n").alias("n"), count(F.col("stop"))("stops"), count(F.col("lower"))("lowers"), count(F.col("upper") & F.col("within"))("uppers")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("stops"), F.lit(0)).alias("stops")).first()
    n, p = F.lit(float(max(total["n"], 1))), F.lit(total["stops"] / max(total["n"], 1))
    without = F.col("n") - F.col("stops")
    ratio = 2 * (F.col("stops") * F.ln(F.try_divide(F.lit(0.99), p)) + F.when(without > 0, without * F.ln(F.try_divide(F.lit(0.01), 1 - p))).otherwise(0.0))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -without)
    abbreviations = cut(words.filter((F.col("stops") > 0) & has_letter(F.col("word"))).select("word", "stops", score.alias("score")).filter(F.col("score") >= ABBREVIATION))
    beside = held.filter("next IS NOT NULL").groupBy("token", "next").agg(F.sum("n").alias("n"))
    asked = beside.select(F.explode(F.array(F.struct(_known(F.col("token")).alias("t"), _known(F.col("next"))["word"].alias("next")))).alias("p"), "n").select("p.t.word", "p.t.stop", "p.next", "n")
    pairs = cut(asked.filter("stop AND word <> '' AND next <> ''").groupBy("word", "next").agg(F.sum("n").alias("k")))
    counts = words.select(F.col("word").alias("next"), F.col("n").alias("n2"))
    known = lambda name: has_letter(F.col(name))
    met = pairs.join(small(abbreviations.select("word", "stops")), "word").filter(known("next")).join(counts, "next")
    found = met.withColumn("ratio", _ratio(*(F.col(c).cast("double") for c in ("k", "stops", "n2")), n))
    collocations = cut(found.filter((F.col("ratio") >= COLLOCATION) & (F.col("k") * n > F.col("stops") * F.col("n2"))).select("word", "next"))
    sure = pairs.join(small(abbreviations.select("word")), "word", "left_anti").filter(known("word") & ~is_initial(F.col("word"))).groupBy("next").agg(F.sum("k").alias("k"))
    breaks = F.lit(float(sure.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()["k"]))
    after = sure.filter(known("next")).join(counts, "next").withColumn("ratio", _ratio(F.col("k").cast("double"), breaks, F.col("n2").cast("double"), n))
    starters = cut(after.filter((F.col("ratio") >= STARTER) & (F.col("k") * n > breaks * F.col("n2"))).select(F.col("next").alias("word")))
    return Model(words, abbreviations, collocations, starters)


def small(table: DataFrame) -> DataFrame:
    """A hint to send a table to every task, if it is as small as that."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def boundaries(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `sentences`, in order, each without the blanks at its ends.

    `!` and `?` end a sentence, an ellipsis before a capital, a period unless it belongs to an abbreviation or an initial;
    after those it ends one only if the next word is a capital, no collocation with it, and either known to begin sentences
    or never a capital within one. Numbers with a period end a sentence unless a small letter follows. Only the places in
    question leave their row, by word; texts of any length are read whole; null and empty texts have no sentences; rows
    that share doc_id and text are alike, so that they need no key of their own."""
    key = ["doc_id", "_hash"]
    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # Outer, as in counted(). Rows that are alike ask twice, and their places are one set.
    open_ = marked(rows.select(*key, "text")).select(*key, F.explode_outer("_marks").alias("t")).select(*key, "t.at", "t.word", "t.next", "t.next_upper", "t.stop").filter(F.col("stop") & F.col("next").isNotNull() & has_letter(F.col("word")))
    short = small(model.abbreviations.select("word", F.lit(True).alias("_short")))
    asked = open_.join(short, "word", "left").filter(F.coalesce("_short", F.lit(False)) | is_initial(F.col("word")))
    nexts = model.words.select(F.col("word").alias("next"), ((F.col("lowers") > 0) & (F.col("uppers") == 0)).alias("_small"))
    looked = asked.join(nexts, "next", "left").join(small(model.starters.select(F.col("word").alias("next"), F.lit(True).alias("_starts"))), "next", "left")
    looked = looked.join(small(model.collocations.select("word", "next", F.lit(True).alias("_pair"))), ["word", "next"], "left")
    kept = F.coalesce("_pair", F.lit(False)) | ~F.col("next_upper") | ~(F.coalesce("_starts", F.lit(False)) | F.coalesce("_small", F.lit(False)))
    closed = looked.filter(kept).groupBy(*key).agg(F.collect_set("at").alias("_closed"))
    joined = rows.join(closed.withColumnsRenamed({"doc_id": "_i", "_hash": "_h"}), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    # Texts are cut up behind the join, so that they and not their tokens move.
    return marked(joined).withColumn("sentences", _cut_at()).drop("_hash", "_i", "_h", "_closed", "_tokens", "_marks")


def _cut_at() -> Column:
    """Sentences of _tokens: ends are listed first, then each sentence is one slice."""

    def ends(x: Column) -> Column:
        number = F.when(x["word"] == "##", ~x["next_lower"]).otherwise(True)
        return F.when(x["loud"], True).when(x["stop"], number).when(x["ends"], x["next_upper"]).otherwise(False)

    last = F.when(F.size("_tokens") > 0, F.array(F.size("_tokens") - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.concat(F.transform(F.filter("_marks", ends), lambda x: x["at"]), last)
    open_ = F.array_except(listed, F.coalesce("_closed", F.array().cast("array<int>")))
    strip = lambda c: F.regexp_replace(c, f"{BLANK}+$", "")
    whole = lambda own: F.transform(own, lambda end, i: strip(F.array_join(F.slice("_tokens", F.when(i == 0, 0).otherwise(F.get(own, i - 1) + 1) + 1, end - F.when(i == 0, -1).otherwise(F.get(own, i - 1))), "")))
    return let(open_, whole)
