"""Keyed state on streams with several state variables: sessions by list state and timers, and tables that a replayed
batch leaves as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausewright.operators.sessions import HISTORY, IDLE_SECONDS
from clausewright.sources.shared import store_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCESS = "user_id long, event_id long, session_start timestamp, created boolean, n_messages int, history array<long>"


class Sessions(StatefulProcessor):
    """ST1 and ST3: a session's start, its last access, and its last messages, each a state variable of its own. By event
    time a timer clears them once the watermark is past the idle time; by processing time they expire by TTL."""

    def __init__(self, idle: int, most: int, event_time: bool):
        self.idle, self.most, self.event_time = idle * 1000, most, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.event_time else self.idle
        self.handle = handle
        self.times = handle.getValueState("times", "start long, last long", ttl)
        self.messages = handle.getListState("messages", "event_id long", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, last = self.times.get() if self.times.exists() else (None, None)
        before, held, out = last, [r[0] for r in self.messages.get()] if start is not None else [], []
        accesses = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for event, at in zip(accesses["event_id"].tolist(), accesses["at"].tolist()):
            created = start is None or at - last > self.idle * 1000
            if created:
                start, last, held = at, at, []
            last = max(last, at)
            held = [*held, event][-self.most :]
            out.append((key[0], event, pd.Timestamp(start, unit="us"), created, len(held), held))
        self.times.update((start, last))
        self.messages.put([(e,) for e in held])
        if self.event_time:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(max(self._end(last), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "session_start", "created", "n_messages", "history"])

    def _end(self, last: int) -> int:
        return last // 1000 + self.idle + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer that was set at the watermark, and not at the session's end, may be behind a later access.
        if self.times.exists() and self._end(self.times.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
            self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_session_states(accesses: DataFrame, idle: int = IDLE_SECONDS, most: int = HISTORY, late: str = "10 minutes", event_time: bool = True) -> DataFrame:
    """session_states() on a stream: accesses (user_id, event_id, ts) as rows of ACCESS, each with its session's start,
    whether it made it, and the last messages. Rows behind the watermark are dropped; rows that are late within it belong
    to the open session. The state of a user is a row for each of few messages, and none once the session is over. Needs
    the RocksDB state store. By processing time a query runs batches on end, as state may expire at any time, so that the
    trigger availableNow would not stop."""
    timed = accesses.withWatermark("ts", late) if event_time else accesses
    own = timed.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), *(["ts"] if event_time else []), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return own.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sessions(idle, most, event_time), outputStructType=ACCESS, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime")


# Upserts --------------------------------------------------------------------------------------------------------------


class UpsertTable:
    """ST5, ST9 and SK7 on streams: the latest row of each key in a folder, written by micro-batches.

    Each batch writes the latest of its rows to a folder named after its id, over whatever a failed try left there, so a
    replayed batch changes nothing. compact() folds batches into a base; batches that it holds are not written again.
    Readers take the newest base and the batches after it. Latest is the greatest of `order` (ties: the greatest row)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: str):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order
        self.schema = spark.createDataFrame([], schema).schema

    def _ids(self, kind: str) -> list[int]:
        from pyarrow import fs

        store, root = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True))
        done = lambda path: store.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.File
        return sorted(int(m[1]) for i in found if (m := re.fullmatch(r"\d+", i.base_name) and re.fullmatch(r"(\d+)", i.base_name)) and done(i.path))

    def base(self) -> int:
        return max(self._ids("base"), default=-1)

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        best = F.max(F.struct(F.col(self.order).alias("_order"), *(F.col(c).alias(c) for c in rest)))
        return rows.groupBy(self.key).agg(best.alias("_best")).select(*(F.col(c) if c == self.key else F.col(f"_best.{c}").alias(c) for c in self.schema.names))

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        if batch_id > self.base():
            self._latest(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.folder}/batch/{batch_id}")

    def _rows(self) -> DataFrame:
        base = self.base()
        paths = [f"{self.folder}/base/{base}"] * (base >= 0) + [f"{self.folder}/batch/{i}" for i in self._ids("batch") if i > base]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._latest(self._rows())

    def compact(self) -> None:
        """Readers see the same before, during and after it: the base counts once it is whole, and only then do the
        batches in it go. An older base stays until the next time, for readers that have begun."""
        ids, base = self._ids("batch"), self.base()
        if not ids or ids[-1] <= base:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base/{ids[-1]}")
        store, root = store_of(self.folder)
        for i in ids:
            store.delete_dir(f"{root}/batch/{i}")
        for i in self._ids("base")[:-2]:
            store.delete_dir(f"{root}/base/{i}")

    def start(self, updates: DataFrame, checkpoint: str, **trigger):
        """The running query that keeps the table by the stream of updates."""
        return updates.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
