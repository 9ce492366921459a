"""Silent workers and tasks: nothing but time passes, and they are found."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from strandspark.streaming import timers

SCHEMA = "worker string, ts timestamp, event string, task string, expected_ms double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGAN = datetime(2024, 1, 1, 12)


@pytest.fixture
def stream(spark, tmp_path):
    """(put, start): files of events, and a query over them whose rows come to a memory table."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    queries, folder = [], tmp_path / "events"
    folder.mkdir()

    def put(*rows):
        made = [(w, BEGAN + timedelta(seconds=s), e, t, x) for w, s, e, t, x in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").json(str(folder))

    def start(name, **how):
        events = spark.readStream.schema(SCHEMA).json(str(folder))
        q = timers.watched(events, **how).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()
        queries.append(q)
        return q

    yield put, start
    for q in queries:
        q.stop()
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def found(spark, name):
    return sorted(((r["worker"], r["task"], r["found"]) for r in spark.table(name).collect()), key=str)


def awaited(spark, name, want, seconds=90):
    end = time.time() + seconds
    while time.time() < end and found(spark, name) != want:
        time.sleep(0.5)
    assert found(spark, name) == want


def test_silence_is_found_without_any_other_event(spark, stream):
    """One worker, one batch of events, then nothing: the task is overdue, later the worker is lost and its other task given out again."""
    put, start = stream
    put(("w1", 0, "assigned", "quick", 500.0), ("w1", 0, "assigned", "slow", 10_000_000.0), ("w1", 0, "assigned", "over", 100.0), ("w1", 1, "done", "over", None))
    start("silent", silence=12, least=2)
    awaited(spark, "silent", [("w1", "quick", "overdue")])
    awaited(spark, "silent", sorted([("w1", "quick", "overdue"), ("w1", None, "lost"), ("w1", "slow", "again")], key=str))


def test_time_of_events(spark, stream):
    """By the events' own time what is found follows from the rows alone; an event brings a lost worker back."""
    put, start = stream
    q = start("told", silence=60, least=10, by_event=True)
    put(("a", 0, "assigned", "t1", 5_000.0), ("a", 0, "assigned", "t2", 40_000.0), ("b", 0, "beat", None, None), (None, 0, "beat", None, None))
    q.processAllAvailable()
    put(("b", 40, "beat", None, None), ("a", 30, "beat", None, None))
    q.processAllAvailable()
    put(("b", 200, "beat", None, None))
    q.processAllAvailable()
    put(("b", 230, "beat", None, None), ("a", 231, "assigned", "t3", 1.0))
    q.processAllAvailable()
    put(("b", 300, "beat", None, None))
    q.processAllAvailable()
    got = {(r["worker"], r["task"], r["found"], (r["at"] - BEGAN).total_seconds()) for r in spark.table("told").collect()}
    assert {("a", "t1", "overdue", 15.0), ("a", None, "lost", 90.0), ("a", "t2", "again", 90.0), ("", None, "lost", 60.0)} <= got
    assert ("a", "t3", "overdue", 241.0) in got and not any(x[0] == "b" and x[2] != "lost" for x in got)


def test_silences_of_a_table(spark):
    rows = [("a", 0), ("a", 5), ("a", 40), ("b", 95), (None, 1)]
    got = timers.silences(spark.createDataFrame(rows, "w string, at long"), "w", "at", 20, F.lit(100)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("a", 5, 25), ("a", 40, 60), (None, 1, 21)], key=str)


def test_unfinished_tasks_of_a_table(spark):
    rows = [(1, "a", "assigned", 0), (1, None, "done", 9), (2, "a", "assigned", 0), (2, None, "done", 11), (3, "b", "assigned", 5), (4, "b", "assigned", 95)]
    df = spark.createDataFrame(rows, "task int, worker string, event string, at int")
    got = timers.unfinished(df, "worker", "task", F.col("event") == "assigned", F.col("event") == "done", "at", F.lit(10), F.lit(100)).collect()
    assert sorted(map(tuple, got)) == [(2, "a", 10), (3, "b", 15)]
