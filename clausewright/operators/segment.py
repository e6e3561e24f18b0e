"""Splitting texts into paragraphs and chunks: generators, islands over lags, and the few true folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T

SHORT = 40
#: Line ends of Python's splitlines().
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"


def paragraphs_of(text: Column) -> Column:
    """G4 within one text: the array of its paragraphs. A paragraph begins after a blank line and at every boundary
    line; its lines are joined by one space. A fold over the lines, so that no line leaves its row."""
    found = F.transform(F.split(T.normalise_layout(text), LINE_ENDS), T.strip)
    lines = F.transform(found, lambda x: F.struct(x.alias("line"), T.is_boundary(x).alias("starts")))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        blank = x["line"] == ""
        closes = acc["open"].isNotNull() & (blank | x["starts"])
        now = F.when(blank, F.lit(None)).when(x["starts"] | acc["open"].isNull(), x["line"]).otherwise(F.concat_ws(" ", acc["open"], x["line"]))
        return F.struct(F.when(closes, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]).alias("out"), now.alias("open"))

    return F.aggregate(lines, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["open"])))


def split_structural(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text) of every paragraph. Null and blank texts have none."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col("text"))).alias("para_idx", "text"))


def ordered_texts(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, parts): the paragraphs of a document as an array, in order."""
    return paragraphs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]).alias("parts"))


def numbered(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", F.posexplode("parts").alias("para_idx", "text"))


def merge_orphans(parts: Column, short: int = SHORT) -> Column:
    """A paragraph shorter than `short` that is no heading joins the next; the joined text is tested again; a last
    orphan joins the one before. A fold over the array, within the JVM."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("pending"))

    def step(acc: Column, part: Column) -> Column:
        now = F.concat_ws(" ", acc["pending"], part)
        orphan = (F.length(now) < short) & ~T.is_split_heading(now)
        return F.struct(F.when(orphan, acc["out"]).otherwise(F.array_append(acc["out"], now)).alias("out"), F.when(orphan, now).alias("pending"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["out"])
        last = F.concat_ws(" ", F.element_at(acc["out"], -1), acc["pending"])
        return F.when(acc["pending"].isNull(), acc["out"]).when(n == 0, F.array(acc["pending"])).otherwise(F.array_append(F.slice(acc["out"], F.lit(1), n - 1), last))

    return F.aggregate(parts, empty, step, finish)


def pipeline_records(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, id, text, is_heading, char_count)."""
    return paragraphs.select("doc_id", F.col("para_idx").alias("id"), "text", T.is_split_heading(F.col("text")).alias("is_heading"), F.length("text").alias("char_count"))


def simple_split(text: Column, kind: str) -> Column:
    """The plain splitters. extract and ocr join inner lines and keep longer parts; legacy and legacy_few fall back
    to lines if blank lines give none, or fewer than five, parts; blank keeps what is not blank."""
    parts = F.filter(F.transform(F.split(text, r"\n\n"), T.strip), lambda p: p != "")
    lines = F.filter(F.transform(F.split(text, r"\n"), T.strip), lambda p: p != "")
    if kind in ("extract", "ocr"):
        flat = F.transform(F.split(text, r"\n\n" if kind == "extract" else r"\n\s*\n"), lambda p: T.strip(T.sub(F.replace(p, F.lit("\n"), F.lit(" ")), " +", " ")))
        return F.filter(flat, lambda p: F.length(p) > 10 if kind == "extract" else F.length(p) >= 20)
    if kind == "legacy":
        return F.when(F.size(parts) == 0, lines).otherwise(parts)
    if kind == "legacy_few":
        return F.when(F.size(parts) < 5, lines).otherwise(parts)
    return parts


def long_parts(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), T.strip), lambda p: F.length(p) > 30)


def windows(text: Column, most: int = 900) -> Column:
    """The window step of G9: pieces of `most` characters, cut at the last space of the second half. Where the next one
    begins depends on the cut, so this is a fold; it is bounded by the number of half windows."""
    n = F.length(text)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def step(acc: Column, _: Column) -> Column:
        i = acc["i"]
        j = F.least(i + most, n)
        piece = T.strip(F.substring(text, i + 1, j - i))
        cut = F.length(piece) - F.instr(F.reverse(piece), " ")
        cuts = (j < n) & (F.instr(piece, " ") > 0) & (cut > most // 2)
        kept = F.when(cuts, T.strip(F.substring(text, i + 1, cut))).otherwise(piece)
        grown = F.when((i < n) & (F.length(kept) > 30), F.array_append(acc["out"], kept)).otherwise(acc["out"])
        return F.struct(grown.alias("out"), F.when(i >= n, i).when(cuts, i + cut + 1).otherwise(j).alias("i"))

    steps = F.sequence(F.lit(0), F.ceil(n / (most // 2)).cast("int"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed at every step."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def clause_chunks(text: Column) -> Column:
    """Chunks for the clause map. Blank-line parts if two are long, else lines if two are long, else the one long
    part (or the whole text) in windows. If just one part is long, the short ones are lost, as in the source behaviour."""
    none = F.array().cast("array<string>")
    in_windows = lambda blob: F.when(F.length(blob) <= 30, none).when(F.length(blob) > 900, windows(blob)).otherwise(F.array(blob))
    by_lines = lambda t, blank: let(long_parts(t, r"\n+"), lambda lines: F.when(F.size(lines) >= 2, lines).otherwise(let(F.coalesce(F.get(blank, F.lit(0)), t), in_windows)))
    chosen = let(T.strip(text), lambda t: let(long_parts(t, r"\n{2,}"), lambda blank: F.when(F.size(blank) >= 2, blank).otherwise(by_lines(t, blank))))
    return F.coalesce(chosen, none)


def restructure(paragraphs: DataFrame) -> DataFrame:
    """Cleaned, blanks dropped, broken paragraphs merged, cleaned again; (doc_id, para_idx, text).
    Whether to merge reads only the end of what came before, which is the end of the previous part: islands over a lag."""
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    clean = paragraphs.select("doc_id", "para_idx", T.clean_paragraph(F.col("text")).alias("text")).filter("text <> ''")
    previous = F.lag("text").over(order)
    marked = clean.withColumn("previous", previous).withColumn("starts", (~T.merges_with(F.col("text"), F.col("previous")) | F.col("previous").isNull()).cast("int"))
    islands = marked.withColumn("group_no", (F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    glue = F.when((F.col("starts") == 1) | F.col("previous").rlike("[ -]$"), F.lit("")).otherwise(F.lit(" "))
    merged = islands.groupBy("doc_id", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", F.concat(glue, "text").alias("part")))), lambda x: x["part"]), "").alias("text"))
    return merged.select("doc_id", F.col("group_no").alias("para_idx"), T.clean_paragraph(F.col("text")).alias("text")).filter("text <> ''")


def hard_split(size: Column, limit: int) -> Column:
    """(first, n) of the pieces of `limit` words of so many."""
    return F.transform(F.sequence(F.lit(0), size - 1, F.lit(limit)), lambda i: F.struct(i.alias("first"), F.least(size - i, F.lit(limit)).alias("n")))


def overlap_words(found: Column, limit: int = 700) -> Column:
    """S3 on the words of a text's sentences: the words of each chunk of whole sentences up to `limit` words, each begun
    with the last words of the one before. A sentence over the limit is emitted in pieces at once, before the chunk that is
    still open. A fold over the sentences' lengths alone: a chunk is a run of consecutive words, those of the sentences
    within the limit or of those over it."""
    overlap = max(50, limit // 10)
    piece = "struct<over:boolean,first:int,n:int>"
    start = F.struct(F.array().cast(f"array<{piece}>").alias("out"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("over"))
    of = lambda over, first, n: F.struct(F.lit(over).alias("over"), first.alias("first"), n.alias("n"))

    def step(acc: Column, size: Column) -> Column:
        long, full = size > limit, acc["b"] - acc["a"] + size > limit
        pieces = F.transform(hard_split(size, limit), lambda x: of(True, acc["over"] + x["first"], x["n"]))
        flushed = F.when(acc["b"] > acc["a"], F.array_append(acc["out"], of(False, acc["a"], acc["b"] - acc["a"]))).otherwise(acc["out"])
        return F.struct(
            F.when(long, F.concat(acc["out"], pieces)).when(full, flushed).otherwise(acc["out"]).alias("out"),
            F.when(~long & full, F.greatest(acc["a"], acc["b"] - overlap)).otherwise(acc["a"]).alias("a"),
            F.when(long, acc["b"]).otherwise(acc["b"] + size).alias("b"),
            F.when(long, acc["over"] + size).otherwise(acc["over"]).alias("over"),
        )

    done = lambda acc: F.when(acc["b"] > acc["a"], F.array_append(acc["out"], of(False, acc["a"], acc["b"] - acc["a"]))).otherwise(acc["out"])

    own = lambda keep: F.flatten(F.filter(found, keep))
    pieces = F.aggregate(F.transform(found, F.size), start, step, done)
    parts = lambda within, over: F.transform(pieces, lambda x: F.slice(F.when(x["over"], over).otherwise(within), x["first"] + 1, x["n"]))
    return let(own(lambda w: F.size(w) <= limit), lambda within: let(own(lambda w: F.size(w) > limit), lambda over: parts(within, over)))


def overlap_chunks(text: Column, limit: int = 700) -> Column:
    """S3: overlap_words() of the cleaned text, as texts."""
    found = F.transform(T.sentences(T.clean_summary(text)), T.clean_words)
    return F.transform(let(found, lambda own: overlap_words(own, limit)), lambda chunk: F.array_join(chunk, " "))
