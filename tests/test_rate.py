"""The rate limiter by composed links, held against the fold."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from clausewright.operators.rate import rate_windows
from clausewright.operators.sessions import RateState, rate_decisions

SCHEMA = "user_id long, event_id long, ts timestamp"


@pytest.mark.parametrize("clients", [1, 5])
def test_same_decisions_as_the_fold(spark, clients):
    choose, now, rows = random.Random(clients), 0.0, []
    for i in range(400):
        now += choose.choice([0, 0.000001, 1, 5, 20, 59.999999, 60, 60.000001, 200])
        rows.append((choose.randrange(clients) or None, i if i % 2 else 1000 - i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now)))
    frame = spark.createDataFrame(rows, SCHEMA)
    for most in (1, 3):
        expected, states = {}, {}
        for user, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
            state = states.setdefault(user, RateState(most=most, seconds=60_000_000))
            expected[user, event] = state.allow((ts - dt.datetime(2024, 1, 1)) // dt.timedelta(microseconds=1))
        got = {(r["client"], r["event_id"]): r["allowed"] for r in rate_windows(frame, most=most).collect()}
        assert got == expected
    whole = frame.withColumn("ts", frame["ts"].cast("long").cast("timestamp"))
    assert {tuple(r) for r in rate_windows(whole, most=3).collect()} == {tuple(r) for r in rate_decisions(whole, most=3).collect()}


def test_no_requests(spark):
    assert rate_windows(spark.createDataFrame([], SCHEMA)).collect() == []
