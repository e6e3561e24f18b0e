"""Sessions with list state and timers, and tables by idempotent upserts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from clausewright.operators.sessions import session_states
from clausewright.streaming.keyed import ACCESS, UpsertTable, stream_session_states

EVENT = "user_id long, event_id long, ts timestamp"


class Files:
    """A stream that gets a file at a time, and what it has written so far."""

    def __init__(self, spark, tmp_path, schema, make, **trigger):
        self.spark, self.root, self.schema, self.made, self.trigger = spark, tmp_path, schema, make, trigger or {"availableNow": True}
        (tmp_path / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.root / "in"))
        stream = self.made(self.spark.readStream.schema(self.schema).parquet(str(self.root / "in")))
        query = stream.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "cp")).trigger(**self.trigger).start()
        query.awaitTermination()

    def out(self, schema):
        return self.spark.read.schema(schema).parquet(str(self.root / "out"))


def at(seconds):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_batch_and_stream_agree(spark, tmp_path):
    choose = random.Random(21)
    rows, now = [], 0
    for i in range(160):
        now += choose.choice([1, 60, 900, 1800, 1801, 4000])
        rows.append((choose.randint(1, 3), i, at(now)))
    files = Files(spark, tmp_path, EVENT, lambda s: stream_session_states(s, late="1 second"))
    for k in range(0, 160, 40):
        files.add(rows[k : k + 40])
    got = {(r["user_id"], r["event_id"]): (r["created"], r["n_messages"], r["history"]) for r in files.out(ACCESS).collect()}
    expected = session_states(spark.createDataFrame(rows, EVENT)).collect()
    assert {k: v[:2] for k, v in got.items()} == {(r["user_id"], r["event_id"]): (r["created"], r["n_messages"]) for r in expected}
    number = {(r["user_id"], r["event_id"]): r["session_no"] for r in expected}
    for (user, event), (_, _, history) in got.items():
        own = [e for (u, e), n in number.items() if u == user and n == number[user, event] and e <= event]
        assert history == sorted(own)[-6:]


def test_expiry_and_late_rows(spark, tmp_path):
    files = Files(spark, tmp_path, EVENT, lambda s: stream_session_states(s, idle=100, late="50 seconds"))
    files.add([(1, 1, at(0)), (1, 2, at(60)), (2, 3, at(90))])
    files.add([(1, 4, at(55)), (1, 5, at(2))])  # late by a little, and behind the watermark of 40
    files.add([(2, 6, at(1000))])  # the watermark passes the end of both sessions
    files.add([(1, 7, at(955)), (2, 8, at(1010))])
    got = {r["event_id"]: (r["created"], r["history"]) for r in files.out(ACCESS).collect()}
    assert got == {1: (True, [1]), 2: (False, [1, 2]), 3: (True, [3]), 4: (False, [1, 2, 4]), 6: (True, [6]), 7: (True, [7]), 8: (False, [6, 8])}
    state = spark.read.format("statestore").option("stateVarName", "messages").load(str(tmp_path / "cp"))
    assert {r[0] for r in state.select("key.user_id").distinct().collect()} == {1, 2}


def test_sessions_expire_by_processing_time(spark, tmp_path):
    files = Files(spark, tmp_path, EVENT, lambda s: stream_session_states(s, idle=8, event_time=False), once=True)
    files.add([(1, 1, at(0))])
    files.add([(1, 2, at(1))])
    time.sleep(9)
    files.add([(1, 3, at(2))])
    got = {r["event_id"]: r["history"] for r in files.out(ACCESS).collect()}
    assert got[1] == [1] and got[3] == [3] and got[2] in ([1, 2], [2])


STATUS = "task_id string, ts timestamp, status string"


@pytest.fixture
def held(spark, tmp_path):
    return UpsertTable(spark, f"file://{tmp_path}/table", STATUS, "task_id", "ts")


def rows_of(held):
    return sorted((r["task_id"], r["status"]) for r in held.read().collect())


def test_a_replayed_batch_changes_nothing(spark, held):
    first = spark.createDataFrame([("a", at(0), "STARTED"), ("a", at(5), "RETRY"), ("b", at(1), "STARTED"), ("b", at(1), "FAILURE"), (None, at(1), "x")], STATUS)
    second = spark.createDataFrame([("a", at(3), "late"), ("b", at(9), "SUCCESS")], STATUS)
    assert held.read().collect() == []
    held.upsert(first, 0)
    assert held.read().filter("task_id = 'b'").first()["status"] == "STARTED" and held.read().count() == 3
    held.upsert(second, 1)
    state = held.read().orderBy("task_id").collect()
    assert [(r["task_id"], r["status"]) for r in state] == [(None, "x"), ("a", "RETRY"), ("b", "SUCCESS")]
    held.upsert(second, 1)
    held.upsert(first, 0)
    assert held.read().orderBy("task_id").collect() == state
    held.compact()
    assert held.base() == 1 and held.read().orderBy("task_id").collect() == state
    held.upsert(first, 0)  # in the base already
    assert held._ids("batch") == [] and held.read().orderBy("task_id").collect() == state
    held.upsert(spark.createDataFrame([("c", at(2), "STARTED")], STATUS), 2)
    held.compact()
    held.compact()
    assert [r["task_id"] for r in held.read().orderBy("task_id").collect()] == [None, "a", "b", "c"]


def test_a_failed_try_is_not_read(spark, held, tmp_path):
    held.upsert(spark.createDataFrame([("a", at(0), "STARTED")], STATUS), 0)
    spark.createDataFrame([("a", at(9), "half")], STATUS).write.parquet(f"{tmp_path}/table/batch/1")
    (tmp_path / "table" / "batch" / "1" / "_SUCCESS").unlink()
    assert rows_of(held) == [("a", "STARTED")]
    held.upsert(spark.createDataFrame([("a", at(5), "SUCCESS")], STATUS), 1)
    assert rows_of(held) == [("a", "SUCCESS")]


def test_a_table_kept_by_a_stream(spark, held, tmp_path):
    choose, rows = random.Random(2), []
    source = tmp_path / "in"
    for k in range(3):
        part = [(choose.choice("abcdef"), at(choose.randint(0, 1000)), choose.choice(["STARTED", "SUCCESS", "FAILURE"])) for _ in range(30)]
        rows += part
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(str(source))
        held.start(spark.readStream.schema(STATUS).parquet(str(source)), str(tmp_path / "cp")).awaitTermination()
        if k == 1:
            held.compact()
    expected = spark.createDataFrame(rows, STATUS).groupBy("task_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status")).collect()
    assert rows_of(held) == sorted((r["task_id"], r["status"]) for r in expected)
