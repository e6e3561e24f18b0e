"""Every registered query of the library against its SQL."""

from __future__ import annotations

import datetime as dt
import sys

import duckdb
import pytest

from clausewright.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected


def test_queries_without_sql(spark, small):
    assert QUERIES["risk_report_json"](spark, small).count() > 0
    # Trained on the rules' own labels: near them, but not the same on every engine.
    assert QUERIES["clause_classifier"](spark, small).first()["accuracy"] > 0.9


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "clausewright.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL)
