"""Checks of instruction-tuning rows: prompt, completion, law, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.functions import text as T


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line_no, raw) with blank ones dropped: malformed, prompt, completion (text, or sorted-key JSON of anything
    else) and completion_law. A completion that is null is the text `null`, so it isn't missing."""
    real = lines.filter(T.strip(F.coalesce("raw", F.lit(""))) != "")
    value = F.try_parse_json("raw")
    own = real.withColumn("_v", value)
    raw = F.try_variant_get("_v", "$.completion", "string")
    # Anything but a string reads as JSON with a space after every comma and colon: its words are counted.
    tokens = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]'), F.lit(0))
    spaced = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")
    kind = F.schema_of_variant(F.try_variant_get("_v", "$.completion", "variant"))
    text = F.coalesce(F.when(kind.rlike("^(OBJECT|ARRAY)"), spaced).otherwise(raw), F.lit("null"))
    return own.select(
        "line_no",
        F.col("_v").isNull().alias("malformed"),
        F.coalesce(T.strip(F.try_variant_get("_v", "$.prompt", "string")), F.lit("")).alias("prompt"),
        T.strip(text).alias("completion"),
        F.nullif(T.strip(F.try_variant_get("_v", "$.completion.law", "string")), F.lit("")).alias("completion_law"),
    )


def dataset_issues(lines: DataFrame) -> DataFrame:
    """Q1 to Q5: (line_no, code) of every problem. A repeated prompt is reported at its first line alone."""
    rows = parsed(lines)
    good = ~F.col("malformed")
    both = good & (F.col("prompt") != "") & (F.col("completion") != "")
    norm = T.normalise_prompt(F.col("prompt"))
    named = rows.withColumn("_norm", F.when(both, norm))
    # Good prompts alone are counted, by partial aggregates; rows without one meet nothing in the join.
    repeated = named.filter("_norm IS NOT NULL").groupBy("_norm").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_first")).filter("_n > 1").select(F.col("_first"))
    counted = named.join(repeated, F.col("line_no") == F.col("_first"), "left")
    law = F.nullif(T.strip(F.regexp_extract("prompt", "(?i)" + rules.PROMPT_LAW, 1)), F.lit(""))
    actual = T.normalise_prompt(F.coalesce("completion_law", "completion"))
    expected = reduce(lambda rest, h: F.when(F.col("prompt").rlike("(?i)" + h[0]), h[1].lower()).otherwise(rest), reversed(rules.LAW_HINTS), F.lit(None).cast("string"))
    checks = {
        "malformed_json": F.col("malformed"),
        "missing_prompt": good & (F.col("prompt") == ""),
        "missing_completion": good & (F.col("completion") == ""),
        "duplicate_prompt": both & F.col("_first").isNotNull(),
        "law_mismatch": both & (T.normalise_prompt(law) != T.normalise_prompt(F.col("completion_law"))),
        "scenario_law_suspicious": both & ~actual.contains(expected),
        "short_completion": both & (T.word_total(F.col("completion")) < 8),
    }
    codes = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())), lambda c: c.isNotNull())
    return counted.select("line_no", F.explode(codes).alias("code"))


def require_clean(issues: DataFrame, show: int = 20) -> None:
    """Q6: training refuses a set with problems; the first few are named."""
    first = issues.orderBy("line_no", "code").limit(show).collect()
    if first:
        raise ValueError("dataset problems: " + ", ".join(f"line {r['line_no']}: {r['code']}" for r in first))


def prompt_text(rows: DataFrame) -> DataFrame:
    """SK10: a row rendered as a training prompt."""
    return rows.select("*", F.concat(F.lit("### Instruction:\n"), "prompt", F.lit("\n\n### Response:\n"), "completion").alias("training_text"))


def shuffled_first(rows: DataFrame, key: str, most: int = 10_000, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random order, and its first rows (a top-k, not a full sort)."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


def message_view(summaries: DataFrame, most: int = 10) -> DataFrame:
    """SK9: the clause map of a document as a display message: its largest groups with rounded percentages."""
    line = F.concat(F.col("label"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.round(F.col("avg_confidence") * 100).cast("int").cast("string"), F.lit("%)"))
    kept = summaries.filter(F.col("position") <= most).select("doc_id", "position", line.alias("line"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("message"))
