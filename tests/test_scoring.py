"""Parsers, scores, ledger, judge and bootstrap on hand-made rows."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markwise.functions import ids, parse
from markwise.operators import bootstrap, judge, ledger, score

# text, standard, think, json, first capital, before dot
VECTORS = [
    ('{"answer": "B"}', "B", "B", "B", "B", '{"answer": "B"}'),
    ('```json\n{"answer": "C"}\n```', "C", "C", "C", "C", '```json\n{"answer": "C"}\n```'),
    ('{"explanation": "x", "answer": "D"}', "D", "D", "D", "D", '{"explanation": "x", "answer": "D"}'),
    ("B. Part 3", "B", "B", "B. Part 3", "B", "B"),
    ("The answer is B", "T", "T", "The answer is B", "B", "The answer is B"),
    ("<think>A?</think> C", "", "C", "<think>A?</think> C", "A", "<think>A?</think> C"),
    ("b", "", "", "b", "b", "b"),
    ("", "", "", "", "", ""),
    ('{"answer": bad}', "", "", '{"answer": bad}', '{"answer": bad}', '{"answer": bad}'),
    (" \t'A'\n", "A", "A", "'A'", "A", "'A'"),
    ("Für B", "F", "F", "Für B", "B", "Für B"),
]


@pytest.mark.parametrize("column,parser", [
    (1, parse.standard), (2, parse.think), (3, parse.json_answer), (4, parse.first_capital), (5, parse.before_dot),
])
def test_parsers(spark, column, parser):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, t string")
    got = [r.x for r in df.select("i", parser(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [v[column] for v in VECTORS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("AB{}\"':.anwser \n`jo\r "), max_size=25), min_size=20, max_size=60))
def test_standard_parser_equals_python(spark, texts):
    pattern = re.compile(
        r"""(?:`*json\s*)*\{\s*(?:"explanation"\s*:\s*".*?"\s*,\s*)?"answer"\s*:\s*["']*([A-Z])["'.]*|^["']*([A-Z])["'.]*"""
    )
    want = []
    for t in texts:
        m = pattern.match(t.strip())
        want.append((m.group(1) or m.group(2)) if m else "")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", parse.standard(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == want


def test_mixed_models_and_errors(spark):
    df = spark.createDataFrame([("gemini", "x", "Z"), ("perceptionlm", "A. y", None)], "m string, t string, s string")
    got = df.select(parse.scored_label(F.col("t"), F.col("s"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == ["Z", "A"]
    bad = spark.createDataFrame([("nobody", "x")], "m string, t string")
    with pytest.raises(Exception, match="no parser"):
        bad.select(parse.parse_answer(F.col("t"), F.col("m"))).collect()
    block = df.sparkSession.createDataFrame([('so {"answer": ["a",],} end',)], "t string")
    assert block.select(parse.json_object_with_answer(F.col("t")).alias("x")).first().x == '{"answer": ["a"]}'


def attempts(spark):
    ok = {"q1": [1, 1], "q2": [1, 0], "q3": [0, 0], "q4": [1, 1, 0]}
    rows = [
        (q, i, "A" if right else None, "A", "mating", 4) for q, marks in ok.items() for i, right in enumerate(marks)
    ]
    return spark.createDataFrame(rows, "question_no string, shuff_idx int, prediction string, truth string, category string, n_options int")


@pytest.mark.parametrize("n,want", [(None, (25, 50, 75)), (1, (75, 75, 75))])
def test_modes(spark, n, want):
    t = score.tally(score.filter_shuffles(attempts(spark), n), first=["category", "truth", "n_options"], ordinal="shuff_idx")
    rows = {r.category: r for r in score.score(t).collect()}
    for key in ("mating", score.MICRO):
        assert (rows[key].strict, rows[key].majority, rows[key].any) == want
        assert rows[key].random_chance == 25 and rows[key].freq_chance == 100


def test_missing_category_raises(spark):
    t = score.tally(attempts(spark), first=["category", "truth", "n_options"], ordinal="shuff_idx")
    assert score.score(t.filter("false")).count() == 0
    with pytest.raises(Exception, match="category missing"):
        score.score(t, strict_schema=True, categories=["mating", "tracking"]).collect()


def test_ledger(spark):
    work = spark.createDataFrame([("c1", "1"), ("c2", "2"), ("c3", "3")], "conv_id string, question_no string")
    done = spark.createDataFrame([("c1", True), ("c2", False), ("c1", True)], "conv_id string, ok boolean")
    again = spark.createDataFrame([("1",)], "question_no string")
    key = lambda d: sorted(r.conv_id for r in d.collect())
    assert key(ledger.pending(work, done)) == ["c3"]
    assert key(ledger.pending(work, done, ok=F.col("ok"))) == ["c2", "c3"]
    assert key(ledger.pending(work, done, override=again)) == ["c1", "c3"]
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 0, "n1"), ("a", 1, "n2"), ("c", 2, "n3")], "k string, o int, v string")
    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert rows(ledger.upsert(old, new, "k", "o")) == [("a", "n2"), ("a", "y"), ("b", "z")]
    assert rows(ledger.upsert(old, new, "k", "o", True)) == [("a", "n2"), ("a", "y"), ("b", "z"), ("c", "n3")]


def test_judge_cases(spark):
    rows = [  # has_result, has_qinfo, ok, result
        ("1", True, True, True, "A"), ("2", True, True, True, "B"), ("3", True, True, True, "D"),
        ("4", True, True, False, None), ("5", False, True, False, None), ("6", True, False, True, "A"),
        ("7", True, True, True, "A"),
    ]
    agent = spark.createDataFrame(rows, "question_no string, has_result boolean, has_qinfo boolean, ok boolean, result string")
    agent = agent.withColumns({"truth": F.lit("A"), "abstain_label": F.lit("D")})
    base = spark.createDataFrame(
        [(q, "A" if q == "7" else "C", "A", o) for o, q in enumerate("1234567")] + [("1", "A", "A", 99)],
        "question_no string, prediction string, truth string, o int",
    )
    r = judge.judge(judge.outcomes(agent, judge.first_baseline(base, "o"))).first()
    assert (r.num_total, r.num_correct, r.num_incorrect, r.num_abstain, r.num_failed_code) == (6, 2, 1, 1, 2)
    assert (r.num_overlap, r.error_count, r.error_recovery_count) == (1, 5, 1)
    assert r.accuracy == pytest.approx(200 / 7) and r.baseline_accuracy == pytest.approx(200 / 7)
    assert r.baseline_accuracy_answered == pytest.approx(100 / 6)


def test_bootstrap_draws(spark):
    df = spark.createDataFrame([("r", f"v{i}", i % 2) for i in range(20)], "run_id string, video_id string, m int")
    trials = bootstrap.bootstrap_trials(df, "video_id", ["m"], iters=2000, n_sample=10)
    assert trials.count() == 2000
    ci = bootstrap.confidence_interval(trials, ["m"]).first()
    assert 47 < ci.m_mean < 53 and ci.m_low < 25 and ci.m_high > 75
    hits = np.bincount(bootstrap.draws(0, 2000, 50, 1) % 7)
    assert len(hits) == 7 and all(abs(h - 100_000 / 7) < 600 for h in hits)


@pytest.mark.parametrize("chunk", [1, 4, 1 << 16])
def test_bootstrap_equals_plain_sums(spark, monkeypatch, chunk):
    """Runs of several sizes, one with a null key, whose totals travel in one chunk or in many."""
    monkeypatch.setattr(bootstrap, "CHUNK", chunk)
    rows = [(r, f"v{i:02}", float((i * 7 + k) % 5), k) for r, size in (("a", 13), ("b", 4), (None, 1)) for i in range(size) for k in range(i % 3 + 1)]
    df = spark.createDataFrame(rows, "run_id string, video_id string, m double, h long")
    got = {(r.run_id, r.iter): (r.m, r.h, r.gap) for r in bootstrap.bootstrap_trials(df, "video_id", ["m", "h"], n_sample=6, iters=50).collect()}
    mixed, want = bootstrap.draws(0, 50, 6, 42).reshape(50, 6), {}
    for run in ("a", "b", None):
        videos = sorted({v for r, v, _, _ in rows if r == run})
        sums = [[sum(x) for x in zip(*((m, h, 1) for r, w, m, h in rows if (r, w) == (run, v)))] for v in videos]
        for i in range(50):
            m, h, n = (sum(sums[d % len(videos)][k] for d in mixed[i]) for k in range(3))
            want[run, i] = (m / n, h / n, m / n - h / n)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_canonical_json(spark):
    import hashlib
    import json

    params = {"b": 'say "x"\n', "a": "ü/1"}
    df = spark.createDataFrame([(params,)], "p map<string, string>")
    got = df.select(ids.canonical_json(F.col("p")).alias("j")).first().j
    assert got == json.dumps(params, sort_keys=True, ensure_ascii=False)
    assert ids.recipe_key(params) == hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()
