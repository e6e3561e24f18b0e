"""Keyed state in batch form: sessions, histories, rate limits, task states, registries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.operators.classify import answer, intent

IDLE_SECONDS, HISTORY = 1800, 6
RATE, RATE_SECONDS = 50, 60

#: States of the task queue as they are shown; any other is pending.
TASK_STATES = {"PENDING": "pending", "RECEIVED": "pending", "STARTED": "processing", "RETRY": "retrying", "SUCCESS": "completed", "FAILURE": "failed", "REVOKED": "failed"}


def sessions(events: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """ST1 and ST2: (user_id, session_start, session_end, n_events): a session ends when more than `idle` seconds pass;
    exactly `idle` seconds still belong to it. The same plan runs on streams."""
    # session_window closes an interval at start + gap, exclusive; a microsecond more keeps the exact gap inside.
    found = events.groupBy("user_id", F.session_window("ts", f"{idle} seconds 1 microsecond").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("session_end"))
    return found.select("user_id", F.col("w.start").alias("session_start"), "session_end", "n_events")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total_value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "event_type", "n_events")


def recent_messages(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """ST3 and W4: the last messages of each conversation, whatever the role."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= most)


def session_states(accesses: DataFrame, idle: int = IDLE_SECONDS, most: int = HISTORY) -> DataFrame:
    """ST1 in batch: accesses (user_id, event_id, ts) with the session's state after each: session_no, created (the
    access found none, or one idle for more than `idle` seconds, and made it), and n_messages kept, up to `most`."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    marked = accesses.withColumn("created", F.coalesce(gap > idle * 1_000_000, F.lit(True)))
    numbered = marked.withColumn("session_no", F.sum(F.col("created").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    within = Window.partitionBy("user_id", "session_no").orderBy("ts", "event_id")
    return numbered.withColumn("n_messages", F.least(F.row_number().over(within), F.lit(most))).select("user_id", "event_id", "session_no", "created", "n_messages")


def raw_requests(requests: DataFrame) -> DataFrame:
    """SC12: requests (request_id, text, use_preprocessing, use_hybrid) as they are analysed: a missing flag takes its
    default (preprocessing on, hybrid off), and a blank text is a problem."""
    return requests.select("request_id", "text", F.coalesce("use_preprocessing", F.lit(True)).alias("use_preprocessing"), F.coalesce("use_hybrid", F.lit(False)).alias("use_hybrid"), F.when(F.btrim(F.coalesce("text", F.lit(""))) == "", "empty_text").alias("problem"))


def session_context(messages: DataFrame) -> DataFrame:
    """ST8: messages (session_id, ts, message, contract_text, text) with the text in force. A registered contract comes
    before a pasted text, that before the last one of the session; an intent that needs a text and has none is GENERAL."""
    order = Window.partitionBy("session_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    given = F.coalesce("contract_text", "text")
    named, confidence = intent(F.col("message"))
    known = messages.withColumn("context", F.last(given, ignorenulls=True).over(order)).withColumn("detected", named).withColumn("confidence", confidence)
    needs = F.col("detected").isin("SUMMARY", "RISK", "COMPARE")
    return known.withColumn("intent", F.when(needs & F.col("context").isNull(), "GENERAL").otherwise(F.col("detected")))


def routed(messages: DataFrame) -> DataFrame:
    """The router: messages with intent and context to (…, route, response). Analyses are named by their operator; what
    needs no document is answered at once. Comparison asks for two texts, as its guard demands."""
    has_text = F.col("context").isNotNull()
    two = F.col("text_a").isNotNull() & F.col("text_b").isNotNull() if "text_a" in messages.columns else F.lit(False)
    route = (
        F.when(F.col("intent") == "SUMMARY", F.when(has_text, "summarise").otherwise("ask_for_contract"))
        .when(F.col("intent") == "RISK", F.when(has_text, "risk_report").otherwise("ask_for_contract"))
        .when(F.col("intent") == "CLAUSE_MAP", F.when(has_text, "clause_map").otherwise("ask_for_contract"))
        .when(F.col("intent") == "COMPARE", F.when(two, "compare").otherwise("ask_for_two_contracts"))
        .when(F.col("intent") == "DRAFT", "draft_templates")
        .otherwise("knowledge_base")
    )
    return messages.withColumn("route", route).withColumn("response", F.when(F.col("route") == "knowledge_base", answer(F.col("message"))))


class RateState:
    """ST4: a window opens with the first request and again once more than `seconds` have passed; the first `most`
    requests of a window pass, and rejected ones do not count."""

    def __init__(self, count: int = 0, start: float | None = None, most: int = RATE, seconds: float = RATE_SECONDS):
        self.count, self.start, self.most, self.seconds = count, start, most, seconds

    def allow(self, now: float) -> bool:
        if self.start is None or now - self.start > self.seconds:
            self.count, self.start = 0, now
        if self.count >= self.most:
            return False
        self.count += 1
        return True


def rate_decisions(requests: DataFrame, client: str = "user_id", most: int = RATE, seconds: float = RATE_SECONDS) -> DataFrame:
    """ST4 in batch: requests (client, event_id, ts) with `allowed`. A fold over each client's requests in time order:
    rows come sorted and stream through, so a client's history is never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = ()  # no client yet; null clients are one
        state = RateState(most=most, seconds=seconds)
        for batch in batches:
            out = []
            for who, at in zip(batch["client"].astype(object).where(batch["client"].notna(), None), batch["at"]):
                if who != current:
                    current, state = who, RateState(most=most, seconds=seconds)
                out.append(state.allow(at))
            yield batch[["client", "event_id"]].assign(allowed=out)

    ordered = requests.select(F.col(client).alias("client"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return ordered.repartition("client").sortWithinPartitions("client", "at", "event_id").mapInPandas(run, f"client {requests.schema[client].dataType.simpleString()}, event_id long, allowed boolean")


def latest_status(updates: DataFrame) -> DataFrame:
    """ST5 and ST9: the last state of each key by time (ties: the larger status). updates: (task_id, ts, status)."""
    return updates.groupBy("task_id").agg(F.max("ts").alias("ts"), F.max_by("status", F.struct("ts", "status")).alias("status"))


def shown_state(state) -> Any:
    """ST6."""
    pairs = F.create_map(*(F.lit(x) for pair in TASK_STATES.items() for x in pair))
    return F.coalesce(F.element_at(pairs, F.upper(state)), F.lit("pending"))


def retry_delay(attempt, base: int = 5, most: int = 3) -> Any:
    """ST7: seconds before a retry, null when there is none left."""
    return F.when(attempt < most, base * F.pow(F.lit(2.0), attempt)).cast("int")


def registry(uploads: DataFrame) -> DataFrame:
    """ST9 and O3: the latest record of each contract (ties: the larger name), newest first."""
    latest = uploads.groupBy("contract_id").agg(F.max_by(F.struct(*(c for c in uploads.columns if c != "contract_id")), F.struct("uploaded_at", "name")).alias("r"))
    return latest.select("contract_id", "r.*").orderBy(F.desc("uploaded_at"), "contract_id")


def contract_text(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """SC11: the text of each requested contract; unknown ones have none, and nothing stands in for it."""
    return requests.join(contracts.select("contract_id", "text"), "contract_id", "left")


def search_landmarks(cards: DataFrame, query: str) -> DataFrame:
    """Cards in any column of which the query occurs, in any case."""
    low = F.lit(query.lower())
    hit = F.lit(False)
    for c in ("title", "citation", "tag", "summary", "region", "details"):
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return cards.filter(hit)


def landmarks_found(query: Column) -> Column:
    """P7 for a column of queries: the ids of the cards in any of whose six columns each occurs, in any case, in the
    cards' order; none for null and blank queries. The cards are few and fixed, so they stand in the expression."""
    cards = F.array(*(F.struct(F.lit(c[0]).alias("id"), F.array(*(F.lit(x.lower()) for x in (*c[1:], rules.ANSWERS[c[0]], details(c)))).alias("columns")) for c in rules.LANDMARKS))
    low = F.lower(F.btrim(query))
    hit = F.filter(cards, lambda card: F.exists(card["columns"], lambda x: x.contains(low)))
    return F.when(low != "", F.transform(hit, lambda card: card["id"])).otherwise(F.array().cast("array<string>"))


def details(card: tuple[str, ...]) -> str:
    return f"{card[3]} ({card[4]}), {card[1]}; field: {card[2]}"


def landmark_cards(spark) -> DataFrame:
    rows = [(*card, rules.ANSWERS[card[0]], details(card)) for card in rules.LANDMARKS]
    return spark.createDataFrame(rows, "id string, region string, tag string, title string, citation string, summary string, details string")


def event_log(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SK7: one JSON line per row."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def transcript(messages: DataFrame, rule: str = "\n---\n") -> DataFrame:
    """SK8: a conversation as one text, messages parted by a rule."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", F.upper("role"), "text").alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), rule).alias("transcript"))
