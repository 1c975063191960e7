"""Streams with keyed state: sessions and due times against loops, late rows, restarts, and state that goes."""

import json
from datetime import datetime, timedelta

import pytest

from tracewright.streaming import sessions

SCHEMA = "id long, project string, ts timestamp, original_tokens long, filtered_tokens long"
START = datetime(2024, 1, 1)


def rows(*places, key="p"):
    """Rows of a key at so many minutes."""
    return [(m, key, START + timedelta(minutes=m), 10, 4) for m in places]


@pytest.fixture
def source(spark, tmp_path):
    def put(batch):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return put, stream, str(tmp_path / "out")


def told(got):
    return sorted((r.project, (r.started - START).seconds // 60, (r.ended - START).seconds // 60, r.n, r.original) for r in got.collect())


def test_sessions_of_a_table(spark):
    batch = rows(0, 20, 50, 81, 81, 300) + rows(10, key="q") + [(1, None, START, 1, 1), (2, "p", None, 1, 1)]
    got = sessions.sessions(spark.createDataFrame(batch, SCHEMA))
    want = {("p", 0, 3), ("p", 81, 2), ("p", 300, 1), ("q", 10, 1), (None, 0, 1)}
    assert {(r.project, (r.started - START).seconds // 60, r.n) for r in got.collect()} == want
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sessions_of_a_stream_are_given_once_and_their_state_goes(spark, source):
    put, stream, path = source
    put(rows(0, 10) + rows(5, key="q"))
    put(rows(25))
    assert told(sessions.run_appended(sessions.sessions(stream()), spark, path)) == []  # all may still grow
    put(rows(40) + rows(600))  # the first joins the open session, the second ends it
    got = sessions.run_appended(sessions.sessions(stream()), spark, path)  # goes on from the checkpoint
    assert told(got) == [("p", 0, 40, 4, 40), ("q", 5, 5, 1, 10)]
    put(rows(41))  # more than two hours behind: left out
    put(rows(2000))
    got = sessions.run_appended(sessions.sessions(stream()), spark, path)
    assert [(r.n, r.original) for r in got.orderBy("started").collect()] == [(4, 40), (1, 10), (1, 10)]
    held = spark.read.format("statestore").load(f"{path}/checkpoint")
    assert held.count() == 1  # the session at 2000 alone


def due_by_loop(minutes):
    out, last = [], None
    for m in sorted(minutes):
        if last is None or m - last >= 1440:
            out.append(m)
            last = m
    return out


def test_due_times_of_a_stream(spark, source):
    put, stream, path = source

    def run():
        got = sessions.run_appended(sessions.due_times(stream()), spark, path).collect()
        return {k: sorted(int((r.due - START).total_seconds()) // 60 for r in got if r.project == k) for k in {r.project for r in got}}

    first, second = [700, 3, 1442, 1443, 2900], [2950, 4340, 4400, 5900]
    put(rows(*first) + rows(1, 2, key="q") + [(1, None, START, 1, 1), (2, "p", None, 1, 1)])
    assert run() == {"p": due_by_loop(first), "q": [1]}
    put(rows(*second))
    assert run() == {"p": due_by_loop(first + second), "q": [1]}  # state is read again from the checkpoint
    put(rows(100))  # late
    put(rows(9000, key="q"))
    assert run() == {"p": due_by_loop(first + second), "q": [1, 9000]}
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{path}/checkpoint")
    assert [json.loads(r.k)["key"] for r in held.selectExpr("to_json(key) AS k").collect()] == ["q"]  # the timer took p's
