"""Streams over several files, with late and repeated rows: equal to the batch result, with bounded state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from markwise.operators import logs
from markwise.streaming import live

EVENT = "run_id string, t_ms long, ts timestamp, stage string, action string, message string"
START = datetime(2024, 1, 1)


def event(run, minute, stage, message="m"):
    return run, minute * 60_000, START + timedelta(minutes=minute), stage, "", message


def feed(spark, tmp_path, schema, parts, start):
    """Write one file after the other; the job reads what is new each time. Gives the last query."""
    src = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        query = start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    return query


def kept(query):
    return sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"])


def moves(df):
    return sorted((r.run_id, r.t_ms, r.from_stage, r.to_stage, r.label) for r in df.collect())


def test_late_and_repeated_events(spark, tmp_path):
    parts = [
        [event("a", 0, "x"), event("a", 6, "z"), event("b", 1, "x")],
        [event("a", 3, "y", "n" * 80), event("a", 6, "z"), event("b", 2, None), event("b", 4, "y")],
        [event("a", 3, "y", "n" * 80), event("b", 5, ""), event("b", 8, "x"), event("a", 9, "z")],
        [event("end", 100, "x")], [event("end", 101, "y")],
    ]
    feed(spark, tmp_path, EVENT, parts, lambda rows, path, state: live.ordered_transition_stream(rows, path, state))
    every = spark.createDataFrame([r for p in parts[:3] for r in p], EVENT).distinct()
    want = moves(logs.stage_transitions(every, ["run_id"], ["t_ms"]))
    assert moves(spark.read.parquet(str(tmp_path / "out"))) == want
    assert ("a", 180_000, "x", "y", "n" * 60 + "…") in want


def test_events_beyond_the_watermark_are_dropped(spark, tmp_path):
    parts = [[event("a", 0, "x"), event("a", 60, "y")], [event("a", 30, "late"), event("a", 90, "z")], [event("a", 200, "w")], [event("a", 201, "w")]]
    feed(spark, tmp_path, EVENT, parts, lambda rows, path, state: live.ordered_transition_stream(rows, path, state))
    got = moves(spark.read.parquet(str(tmp_path / "out")))
    assert [(a, b) for _, _, a, b, _ in got] == [("x", "y"), ("y", "z")]


def test_quiet_runs_are_forgotten(spark, tmp_path):
    """Many runs that end leave no state; one that comes back after the time to live starts anew."""
    parts = [[event(f"r{i}", i % 50, "x") for i in range(200)], [event("clock", 100, "x")], [event("clock", 400, "y")],
             [event("clock", 401, "y"), event("r1", 402, "z")], [event("clock", 800, "y")], [event("clock", 801, "y")]]
    query = feed(spark, tmp_path, EVENT, parts, lambda rows, path, state: live.ordered_transition_stream(rows, path, state, keep_hours=2))
    assert kept(query) < 20
    got = moves(spark.read.parquet(str(tmp_path / "out")))
    assert [r[:4] for r in got] == []  # r1: forgotten after minute 121; clock: its stages are more than two hours apart


def test_scoreboard_with_bounded_state(spark, tmp_path):
    """Repeats within the watermark count once, and old keys leave the state."""
    schema = "conv_id string, question_no string, category string, prediction string, truth string, ts timestamp"
    row = lambda i, minute, p: (f"c{i}", f"q{i % 7}", "m", p, "A", START + timedelta(minutes=minute))
    parts = [[row(i, i % 5, "A" if i % 3 else "B") for i in range(100)], [row(i, i % 5 + 1, "B") for i in range(50)] + [row(200, 7, "A")],
             [row(300, 500, "A")], [row(301, 501, "B")]]
    query = feed(spark, tmp_path, schema, parts, lambda rows, path, state: live.scoreboard_stream(rows, path, state, watermark=("ts", "10 minutes")))
    board = live.scoreboard(spark, str(tmp_path / "out"))
    assert tuple(board.agg(F.sum("correct"), F.sum("incorrect")).first()) == (68, 35)
    assert kept(query) <= 4


@pytest.mark.parametrize("batches", [1, 3])
def test_number_of_batches_does_not_show(spark, tmp_path, batches):
    rows = [event(f"r{i % 4}", i // 2, "xyz"[(i * 7) % 3]) for i in range(60)] + [event("end", 500, "x")]
    parts = [rows[k::batches] for k in range(batches)] if batches == 1 else [rows[:18], rows[18:40], rows[40:]]
    feed(spark, tmp_path, EVENT, [*parts, [event("end", 501, "x")]], lambda r, path, state: live.ordered_transition_stream(r, path, state))
    want = moves(logs.stage_transitions(spark.createDataFrame(rows, EVENT), ["run_id"], ["t_ms"]))
    assert moves(spark.read.parquet(str(tmp_path / "out"))) == want
