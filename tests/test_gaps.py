"""Key restriction by join, kept ranges, key-frame look-ups and conversation upserts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from markwise.operators import intervals, ledger, sampling, timeline


def names_of(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_restriction_equals_patterns(spark):
    """Exact names, globs with a literal start, in the middle, at the end, of wildcards alone, and characters with a meaning in patterns."""
    names = ["a", "ab", "abc", "a.c", "x/abc", "abc/x", "zabcz", "", "a+b", "[a]", "abab", "ß漢", None, "a", "*"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "f string, i int")
    entries = ["ab", "a?c", "*c", "*b*b", "??", "a*", "x/*", "[a]", "a+?", "none", "no*", "*漢", "ab", "*/*", "*"]
    for chosen in (entries[:-1], entries, ["zz*"], ["?"], ["ab"], ["*b*"]):
        patterns = {e: re.compile(sampling.glob_pattern(e), re.S) for e in chosen}
        want = [(n, i) for i, n in enumerate(names) if n is not None and any(p.search(n) for p in patterns.values())]
        kept, missing = sampling.restrict_keys(df, "f", include=chosen)
        assert sorted(tuple(r) for r in kept.collect()) == sorted(want)
        assert names_of(missing, "entry") == sorted(e for e, p in patterns.items() if not any(n is not None and p.search(n) for n in names))
        left, _ = sampling.restrict_keys(df, "f", exclude=chosen)
        assert sorted(r.i for r in left.collect()) == sorted(i for i, n in enumerate(names) if n is not None and (n, i) not in want)


def test_many_entries_are_planned_quickly(spark):
    df = spark.range(1000).select(F.concat(F.lit("file"), "id").alias("f"))
    entries = [f"file{i}" for i in range(0, 50_000, 2)] + [f"file{i}*.txt" for i in range(75_000)]
    sampling.restrict_keys(df, "f", include=entries[:10])
    start = time.perf_counter()
    kept, missing = sampling.restrict_keys(df, "f", include=entries)
    assert time.perf_counter() - start < 10
    assert kept.count() == 500 and missing.count() == len(entries) - 500


def test_kept_ranges(spark):
    totals = spark.createDataFrame([("a", 100.0, 5.0, 90.0), ("b", 10.0, None, None), ("c", 10.0, 20.0, None)], "k string, total double, head double, tail double")
    removed = spark.createDataFrame([("a", 30.0, 20.0), ("a", 25.0, 40.0), ("a", 95.0, 300.0), ("b", -5.0, 1.0), ("zz", 0.0, 1.0)], "k string, start double, end double")
    left = intervals.kept_ranges(removed, totals, ["k"], "total", F.col("head"), F.col("tail"))
    assert sorted(tuple(r) for r in left.collect()) == [("a", 5.0, 20.0), ("a", 40.0, 90.0), ("b", 1.0, 10.0)]
    with pytest.raises(Exception, match="no interval is left"):
        intervals.kept_ranges(removed, totals, ["k"], "total", F.col("head"), F.col("tail"), require=True).collect()
    plain = intervals.kept_ranges(removed.limit(0), totals, ["k"], "total")
    assert sorted(tuple(r) for r in plain.collect()) == [("a", 0.0, 100.0), ("b", 0.0, 10.0), ("c", 0.0, 10.0)]


def test_key_frame_look_up(spark):
    frames = spark.createDataFrame([("v", 7, 0, True), ("v", 8, 1, True), ("v", 8, 2, True), ("v", 9, 3, False), ("v", None, 4, True)],
                                   "video string, keyframe_idx int, pos long, is_prompt boolean")
    ask = lambda *k: spark.createDataFrame([("v", i) for i in k], "video string, keyframe_idx int")
    look = lambda r, **how: timeline.look_up_keyframes(r, frames, ["video"], "keyframe_idx", "pos", F.col("is_prompt"), **how)
    assert [(r.keyframe_idx, r.frame_pos) for r in look(ask(7, 7)).collect()] == [(7, 0), (7, 0)]
    with pytest.raises(Exception, match="duplicate key-frame v/8"):
        look(ask(7, 8)).collect()
    with pytest.raises(Exception, match="missing key-frame v/9"):
        look(ask(9)).collect()
    found = look(ask(7, 8, 9), on_problem="null").orderBy("keyframe_idx").collect()
    assert [(r.frame_pos, r.problem) for r in found] == [(0, None), (None, "duplicate"), (None, "missing")]


def test_conversation_upsert(spark):
    store = spark.createDataFrame([("c1", "m/q1/0", "old"), ("c2", "m/q1/1", "old"), ("c3", "m/q2/0", "old"), ("c4", "bare", "old")], "conv_id string, qid_flat string, v string")
    fresh = spark.createDataFrame(
        [("c3", "m/q1/9", "new", 1), ("c5", "m/q3/0", "first", 2), ("c5", "m/q3/0", "second", 3), ("c6", "bare", "new", 4)], "conv_id string, qid_flat string, v string, ordinal int"
    )
    rows, report = ledger.upsert_conversations(store, fresh)
    assert sorted((r.conv_id, r.v) for r in rows.collect()) == [("c1", "old"), ("c2", "old"), ("c3", "old"), ("c4", "old"), ("c5", "first"), ("c6", "new")]
    seen = lambda d: [(r.conv_id, r.clash, r.stored, r.n_replaced) for r in d.orderBy("ordinal").collect()]
    assert seen(report) == [("c3", True, False, 0), ("c5", False, True, 0), ("c5", False, False, 0), ("c6", False, True, 0)]
    rows, report = ledger.upsert_conversations(store, fresh, override=True)
    assert sorted((r.conv_id, r.v) for r in rows.collect()) == [("c3", "new"), ("c4", "old"), ("c5", "second"), ("c6", "new")]
    # c3 takes the place of both conversations of file q1 and of the one stored under its own key.
    assert seen(report) == [("c3", True, True, 3), ("c5", False, False, 0), ("c5", False, True, 0), ("c6", False, True, 0)]
