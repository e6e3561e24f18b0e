"""Structured Streaming forms of the keyed state: sessions, windows, histories and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausewright.operators.sessions import HISTORY, IDLE_SECONDS, RATE, RATE_SECONDS, RateState, sessions, sliding, tumbling


def stream_sessions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST2 on a stream: closed sessions, once the watermark has passed them."""
    return sessions(events.withWatermark("ts", late))


def stream_tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return tumbling(events.withWatermark("ts", late), width)


def stream_sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return sliding(events.withWatermark("ts", late), width, step)


def stream_rate_decisions(requests: DataFrame, most: int = RATE, seconds: float = RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """ST4 on a stream: requests (user_id, event_id, ts) to (user_id, event_id, allowed). Only the open window of a
    client is kept. Once the watermark has passed its end, any further request opens a new one, so it is dropped."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, start = state.get if state.exists else (0, None)
        rate = RateState(count, start, most, seconds)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = [rate.allow(at) for at in rows["at"]]
        state.update((rate.count, rate.start))
        state.setTimeoutTimestamp(max(int((rate.start + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    timed = requests.withWatermark("ts", late).select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, allowed boolean", "count int, start double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_histories(messages: DataFrame, most: int = HISTORY, idle: int = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """ST1 and ST3 on a stream: messages (conv_id, turn, ts) to (conv_id, turns) of the last messages, updated as they
    come. A conversation is created by its first message and forgotten once the watermark has passed `idle` seconds
    beyond its last: a later message finds none and begins anew."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for batch in batches:
            held += batch["turn"].tolist()
            last = max(last, int(batch["at"].max()))
        held = sorted(held)[-most:]
        state.update((held, last))
        state.setTimeoutTimestamp(max(last + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [held]})

    timed = messages.withWatermark("ts", late).select("conv_id", "turn", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"))
    return timed.groupBy("conv_id").applyInPandasWithState(keep, "conv_id long, turns array<long>", "turns array<long>, last long", "update", GroupStateTimeout.EventTimeTimeout)
