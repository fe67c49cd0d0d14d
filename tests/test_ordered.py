"""Ordered scans give the same result however the rows are cut."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markwise.operators import intervals, ordered, packing, render, sampling, timeline
from markwise.operators.ordered import (
    group_size, lag, last_value, lay_out, lead, next_value, ordinal, running_max, running_sum,
)
from markwise.session import shared_dir


def skewed(n=600, seed=0):
    """One key holds a third of the rows; a burst shares one time."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    t = rng.integers(0, 400, n)
    t[key == 0] = np.where(rng.random((key == 0).sum()) < 0.5, 7, t[key == 0])
    value = [None if x < 3 else int(x) for x in rng.integers(0, 10, n)]
    return pd.DataFrame({"k": key, "t": t, "id": np.arange(n), "v": value})


def frame(spark, pdf):
    rows = [tuple(None if pd.isna(x) else int(x) for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "k long, t long, id long, v long")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def expected():
    pdf = skewed().sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = pdf.groupby("k")
    v = pdf["v"].astype(float)
    pdf["i"] = g.cumcount()
    pdf["n"] = g["id"].transform("size")
    pdf["s"] = v.fillna(0).groupby(pdf["k"]).cumsum()
    pdf["m"] = v.groupby(pdf["k"]).transform(lambda x: x.cummax().ffill().shift())
    pdf["last"] = v.groupby(pdf["k"]).ffill()
    pdf["nxt"] = v.groupby(pdf["k"]).bfill()
    pdf["lg"], pdf["ld"] = g["v"].shift(), g["v"].shift(-1)
    return pdf


@pytest.mark.parametrize("slice_rows", [1, 5, 13])
def test_scans(spark, expected, slice_rows):
    v = F.col("v")
    laid = lay_out(frame(spark, skewed()), ["k"], ["t", "id"], slice_rows)
    got = laid.scan(
        i=ordinal(), n=group_size(), s=running_sum(v), m=running_max(v, True), last=last_value(v),
        nxt=next_value(v), lg=lag(v), ld=lead(v),
    ).rows().toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    for c in ("i", "n", "s", "m", "last", "nxt", "lg", "ld"):
        pd.testing.assert_series_equal(got[c].astype(float), expected[c].astype(float), check_names=False)


def test_hot_key_is_cut(spark):
    laid = lay_out(frame(spark, skewed()), ["k"], ["t", "id"], 40)
    assert laid.df.filter("k = 0").select("_slice").distinct().count() > 2


def test_a_key_has_a_bounded_number_of_cuts(spark, expected, monkeypatch):
    """Beyond STEP ** 2 cuts they lie further apart; both steps of the search agree with a plain count."""
    monkeypatch.setattr(ordered, "STEP", 4)
    laid = lay_out(frame(spark, skewed()), ["k"], ["t", "id"], 1)
    slices = laid.df.groupBy("k").agg(F.countDistinct("_slice").alias("n")).collect()
    assert 9 <= max(r.n for r in slices) <= 17
    got = laid.scan(i=ordinal()).rows().toPandas().sort_values(["k", "t", "id"])
    assert got["i"].tolist() == expected["i"].tolist()
    ranks = laid.df.toPandas().sort_values(["k", "t", "id"])
    assert all(g["_slice"].is_monotonic_increasing for _, g in ranks.groupby("k"))


def test_global_order(spark):
    """No key at all: one order over all rows."""
    rows = lay_out(frame(spark, skewed()), [], ["t", "id"], 20).scan(i=ordinal(), n=group_size()).rows()
    assert "_all_rows" not in rows.columns
    got = rows.toPandas().sort_values(["t", "id"])
    assert got["i"].tolist() == list(range(600)) and set(got["n"]) == {600}


def test_no_rows(spark):
    rows = lay_out(frame(spark, skewed()).limit(0), ["k"], ["t", "id"], 2).scan(i=ordinal()).rows()
    assert rows.columns == ["k", "t", "id", "v", "i"] and rows.count() == 0


def test_rows_are_shuffled_once(spark, tmp_path):
    """Two scans in a row are one exchange, nothing is written, and a cut key adds aggregates only."""
    path = str(tmp_path / "rows")
    frame(spark, skewed()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    plan = timeline.compact_time(rows, ["k"], "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    cut = timeline.compact_time(rows, ["k"], "t", ["id"], slice_rows=50)
    whole = timeline.compact_time(rows, ["k"], "t", ["id"])
    assert sorted_rows(cut) == sorted_rows(whole)


@pytest.mark.parametrize("slice_rows", [1, 6])
def test_operators_do_not_depend_on_slices(spark, slice_rows):
    df = frame(spark, skewed())
    spans = df.select("k", F.col("t").alias("start"), (F.col("t") + F.coalesce("v", F.lit(0))).alias("end"))
    merged = intervals.merge_intervals(intervals.normalise_intervals(spans, eps=0), ["k"], eps=0, slice_rows=slice_rows)
    pdf = skewed()
    want = []
    for k, g in pdf.groupby("k"):
        cover = sorted((t, t + int(v)) for t, v in zip(g["t"], g["v"].fillna(0)) if v and not pd.isna(v))
        out = []
        for a, b in cover:
            if b <= a:
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        want += [(k, a, b) for a, b in out]
    assert sorted_rows(merged.select("k", "start", "end")) == sorted(want, key=str)


@pytest.mark.parametrize(("slice_rows", "budget"), [(1, 15), (7, 15), (7, 3), (9, 200), (40, 15), (None, 15)])
def test_packing_equals_loop(spark, slice_rows, budget):
    """Also with budgets below one item and beyond several slices; null keys are a key."""
    pdf = skewed().assign(v=lambda d: d["v"].fillna(0).astype(int))
    rows = frame(spark, pdf).withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    got = packing.pack_batches(rows, ["k"], ["t", "id"], "v", budget, slice_rows).toPandas()
    assert len(got) == len(pdf)
    got = got.sort_values(["k", "t", "id"])
    for _, g in got.groupby("k", dropna=False):
        batch, load = 0, None
        for v, b in zip(g["v"], g["batch_no"]):
            if load is not None and load + v > budget:
                batch, load = batch + 1, v
            else:
                load = v if load is None else load + v
            assert b == batch


def test_composed_reports_equal_one_report():
    """Reports of halves, composed, act like the loop over both; their size stays within one budget."""
    rng = np.random.default_rng(4)

    def jumps(sizes, budget):
        rows, prefix = [], np.concatenate([[0], np.cumsum(sizes)])
        for i in [0, *(i for i in range(1, len(sizes)) if sizes[i] > 0)]:
            load, batches = 0.0, 0
            for j, v in enumerate(sizes[i:]):
                load, batches = (v, batches + 1) if j == 0 or load + v > budget else (load + v, batches)
            rows.append((i, float(prefix[i + 1]), float(load), batches))
        rows.append((len(sizes), np.inf, float(prefix[-1]), 0))
        return packing._reachable(pd.DataFrame(rows, columns=packing._JUMP), budget)

    for _ in range(60):
        budget = int(rng.integers(1, 40))
        a, b = (rng.integers(0, 9, rng.integers(1, 25)) for _ in range(2))
        got = packing._composed(jumps(a, budget), jumps(b, budget), budget)
        assert got["_reach"].is_monotonic_increasing
        for load in range(budget + 1):
            want, batches = load, 0
            for v in [*a, *b]:
                want, batches = (v, batches + 1) if want + v > budget else (want + v, batches)
            hit = got.iloc[int(np.argmax(load + got["_reach"].to_numpy() > budget))]
            assert (hit["_load"] + (0 if np.isfinite(hit["_reach"]) else load), hit["_batches"]) == (want, batches)


@pytest.mark.parametrize("slice_rows", [1, 5])
@pytest.mark.parametrize("mode", ["floor", "ceil", "nearest"])
def test_asof(spark, mode, slice_rows):
    line = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 1.0, 1.0, 2.5])], "k string, t double, i int")
    asked = spark.createDataFrame([("a", q, j) for j, q in enumerate([-1.0, 1.0, 1.75, 9.0])], "k string, q double, j int")
    out = timeline.asof_index(line, asked, ["k"], "t", "i", "q", "j", mode, slice_rows=slice_rows)
    want = {"floor": [0, 2, 2, 3], "ceil": [0, 1, 3, 3], "nearest": [0, 1, 1, 3]}[mode]
    assert [r.matched_idx for r in out.orderBy("j").collect()] == want


def test_asof_empty_timeline(spark):
    line = spark.createDataFrame([], "k string, t double, i int")
    asked = spark.createDataFrame([("a", 1.0, 0)], "k string, q double, j int")
    with pytest.raises(Exception, match="empty timeline"):
        timeline.asof_index(line, asked, ["k"], "t", "i", "q", "j").collect()
    assert timeline.asof_index(line, asked, ["k"], "t", "i", "q", "j", on_empty="null").collect()[0].matched_idx is None


def test_gaps_and_compaction(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([2.0, 2.5, 5.0, 5.5, 9.0])], "k string, t double, i int")
    gaps = timeline.find_gaps(df, ["k"], "t", ["i"]).collect()
    assert sorted((g.gap_start, g.gap_end) for g in gaps) == [(2.5, 5.0), (5.5, 9.0)]
    out = timeline.compact_time(df, ["k"], "t", ["i"], slice_rows=3).orderBy("i").collect()
    assert [r.compact_ts for r in out] == [0, 0.5, 0.5, 1, 1]


def test_intervals(spark):
    rows = [("a", 3.0, 1.0), ("a", 2.0, 4.0), ("a", 6.0, 7.0), ("a", 7.0, 8.0), ("a", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, start double, end double")
    merged = intervals.merge_intervals(intervals.normalise_intervals(df, total=F.lit(10.0)), ["k"])
    assert sorted_rows(merged.select("start", "end")) == [(1.0, 4.0), (6.0, 8.0)]
    total = spark.createDataFrame([("a", 10.0), ("b", 3.0)], "k string, total double")
    left = intervals.invert_intervals(merged, total, ["k"], "total")
    assert sorted_rows(left.select("k", "start", "end")) == [
        ("a", 0.0, 1.0), ("a", 4.0, 6.0), ("a", 8.0, 10.0), ("b", 0.0, 3.0)
    ]
    full = spark.createDataFrame([("a", 0.0, 10.0)], "k string, start double, end double")
    with pytest.raises(Exception, match="no interval is left"):
        intervals.invert_intervals(full, total.filter("k = 'a'"), ["k"], "total", require=True).collect()


def test_repair_and_exclusive(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 3, 2, 7, 7])], "k string, i int, v long")
    out = timeline.strictly_increasing(df, ["k"], ["i"], "v", "o", slice_rows=3).orderBy("i").collect()
    assert [r.o for r in out] == [3, 4, 5, 7, 8]
    frames = spark.createDataFrame([("a", float(i), i) for i in range(5)], "k string, t double, i int")
    prompts = spark.createDataFrame([("a", q, j) for j, q in enumerate([0.5, 0.7, 3.2, 3.3, 3.4])], "k string, q double, j int")
    hit = timeline.match_exclusive(prompts, frames, ["k"], "t", "i", "q", "j").orderBy("j").collect()
    assert [(r.j, r.matched_idx) for r in hit] == [(0, 1), (1, 2), (2, 4)]


@pytest.mark.parametrize("in_budget,sizes", [(False, [4, 5, 3]), (True, [4, 4, 4])])
def test_chunks(spark, in_budget, sizes):
    df = spark.range(10).select(F.col("id").alias("global_idx"), F.lit(10).alias("n"))
    out = sampling.chunk(df, 4, 1, in_budget)
    assert [r["count"] for r in out.groupBy("clip_idx").count().orderBy("clip_idx").collect()] == sizes
    last = out.groupBy("clip_idx").agg(F.max("clip_pos").alias("m"), F.count("*").alias("c")).collect()
    assert all(r.m == r.c - 1 for r in last)


def test_chunk_exact_fit_has_no_tail(spark):
    df = spark.range(256).select(F.col("id").alias("global_idx"), F.lit(256).alias("n"))
    assert sampling.chunk(df).select("clip_idx").distinct().count() == 1
    predicted = sampling.predict_clips(spark.createDataFrame([(256,)], "n int"), 256, 1).first()
    assert predicted.predicted_clips == 2


@pytest.mark.parametrize("n,k", [(1, 4), (3, 8), (10, 4), (100, 32), (7, 7)])
def test_linspace_equals_numpy(spark, n, k):
    sizes = spark.createDataFrame([("a", n)], "k string, n long")
    for mode, want in (
        ("linspace", np.linspace(0, n - 1, k, dtype=int)),
        ("centre", [int(n / k * (i + 0.5)) for i in range(k)]),
        ("stride", np.arange(0, n, n / min(n, k)).astype(int)),
    ):
        got = sampling.sample_positions(sizes, ["k"], k, mode).orderBy("sample_no").collect()
        assert [r.global_idx for r in got] == list(want), mode


def test_subsample_rules(spark):
    rows = [(i, 5 if i == 5 else -1, i, i != 8) for i in range(11)]
    df = spark.createDataFrame(rows, "global_idx int, prompt_frame_idx int, frame_idx int, ok boolean").withColumn("n", F.lit(11))
    out = sampling.subsample(df, 4, sampling.prompt_frame(), [-1], size="n", valid=F.col("ok"))
    assert [r.global_idx for r in out.orderBy("global_idx").collect()] == [0, 4, 5, 10]
    none = spark.createDataFrame([(1, None, None)], "global_idx int, prompt_frame_idx int, frame_idx int")
    assert sampling.subsample(none, 4, sampling.prompt_frame()).count() == 1


def test_forced_sample_modes(spark):
    df = spark.createDataFrame([("a", i, i >= 18) for i in range(20)], "k string, i int, f boolean")
    cut = sampling.sample_with_forced(df, ["k"], ["i"], 4, F.col("f"), keep_forced=False)
    assert [r.i for r in cut.orderBy("i").collect()] == [0, 6, 12, 18]
    kept = sampling.sample_with_forced(df, ["k"], ["i"], 4, F.col("f"), keep_forced=True)
    assert [r.i for r in kept.orderBy("i").collect()] == [0, 6, 18, 19]


def test_selection_and_keys(spark):
    df = spark.range(10).select(F.col("id").alias("frame_idx"))
    ids = lambda d: [r[0] for r in d.orderBy("frame_idx").collect()]
    assert ids(sampling.select_frames(df, indices=[7, 2, 2, 99])) == [2, 7]
    assert ids(sampling.select_frames(df, start=1, step=4, n=2)) == [1, 5]
    with pytest.raises(ValueError):
        sampling.select_frames(df, step=0)
    names = spark.createDataFrame([("001.yaml",), ("002.yaml",)], "f string")
    kept, missing = sampling.restrict_keys(names, "f", include=["001*", "9.yaml"])
    assert kept.count() == 1 and [r.entry for r in missing.collect()] == ["9.yaml"]
    with pytest.raises(ValueError):
        sampling.restrict_keys(names, "f", ["a"], ["b"])
    with pytest.raises(ValueError):
        timeline.frames_between(df, "frame_idx", 1, end=2, delta=3)


def test_long_text_comes_in_chunks(spark):
    rows = [("c", i, "x" * (i % 4)) for i in range(50)] + [("d", 0, "only")]
    df = spark.createDataFrame(rows, "conv_id string, pos int, content string")
    out = render.to_text(df, ["conv_id"], ["pos"], max_chars=10, slice_rows=3).orderBy("conv_id", "chunk_no").collect()
    assert "".join(r.text for r in out if r.conv_id == "c") == "".join(t for k, _, t in rows if k == "c")
    assert sum(r.conv_id == "c" for r in out) > 3
    assert [r.text for r in out if r.conv_id == "d"] == ["only"]
