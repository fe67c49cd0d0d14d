import json

import numpy as np
import pytest

from markwise.operators import colours, evaluate, questions


def _line(no, turn, category, truth, raw, answer, n=4):
    correct = {"label": truth, "raw": raw}
    question = {"qid_flat": f"x/{no}/{turn}", "question_category": category, "question": {"num_options": n, "correct_option": correct}}
    return json.dumps({"conv_id": f"{no}-{turn}", "question": question, "response": f"{answer}. because", "post_processed_response": answer})


def _files(folder, *files):
    for i, lines in enumerate(files):
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    return [str(folder / f"{i}.jsonl") for i in range(len(files))]


def test_whole_evaluation(spark, tmp_path):
    paths = _files(
        tmp_path,
        [_line(1, 0, "mating", "A", "yes", "A"), _line(1, 1, "other", "A", "yes", "B"), _line(2, 0, "tracking", "B", "no", "A", 2)],
        [_line(3, 0, "temporal_loc", "C", "Yes", "C"), _line(4, 0, "temporal_ord", "C", "No", "C"), _line(5, 0, "unlisted", "C", "No", "C")],
    )
    rows = evaluate.evaluate(spark, "openai_gpt", paths=paths).collect()
    assert [r.category for r in rows] == list(evaluate.CATEGORIES)
    found = {r.category: (r.n_questions, r.strict, r.majority, r["any"]) for r in rows}
    assert found["micro_avg"] == (5, 60.0, 60.0, 80.0)  # the unlisted category counts here
    assert found["mating"] == (1, 0.0, 0.0, 100.0)  # its category is that of the first file's first line
    one = {r.category: r.majority for r in evaluate.evaluate(spark, "gemini", paths=paths, n_shuffles=1).collect()}
    assert one["mating"] == 100.0
    binary = evaluate.evaluate(spark, "gemini", paths=",".join(paths), n_shuffles=1, binary=True).collect()
    assert [(r.category, r.n_questions, r.majority) for r in binary] == [
        ("micro_avg", 5, 80.0), ("yes", 2, 100.0), ("no", 3, 100.0 * 2 / 3)
    ]


def test_missing_category_is_an_error(spark, tmp_path):
    paths = _files(tmp_path, [_line(1, 0, "mating", "A", "yes", "A")])
    with pytest.raises(Exception, match="category missing"):
        evaluate.evaluate(spark, "openai_gpt", paths=paths).collect()
    with pytest.raises(ValueError, match="exactly one"):
        evaluate.evaluate(spark, "openai_gpt")


@pytest.mark.parametrize("share", [7, 500, 10_000])
def test_max_min_colours_in_one_hot_group(spark, share):
    """The same picks whatever the shares, and those of plain loops."""
    draw = np.random.default_rng(3)
    cand, refs = draw.random((900, 3)), draw.random((40, 3))
    cand[5] = cand[700]  # a tie of two candidates
    frame = lambda rows, extra: spark.createDataFrame(
        [("g", *([i] if extra else []), *map(float, r)) for i, r in enumerate(rows)], f"grp string, {'ord int, ' if extra else ''}r double, g double, b double"
    )
    got = colours.maxmin_pick(frame(cand, True), frame(refs, False), ["grp"], "ord", "wcag", rounds=4, block=16, candidate_block=share)
    light = lambda rows: (np.where(rows <= 0.03928, rows / 12.92, ((rows + 0.055) / 1.055) ** 2.4) * [0.2126, 0.7152, 0.0722]).sum(axis=1)
    point, known, want = light(cand), list(light(refs)), []
    for no in range(4):
        high, low = np.maximum.outer(point, known), np.minimum.outer(point, known)
        nearest = ((high + 0.05) / (low + 0.05)).min(axis=1)
        best = int(np.argmax(np.round(nearest, 9)))
        want.append((no, best))
        known.append(point[best])
    assert [(r["round"], r["ord"]) for r in got.orderBy("round").collect()] == want


def test_groups_of_a_share_each_and_no_references(spark):
    cand = spark.createDataFrame([(g, i, i / 10, 0.5, 0.5) for g in "ab" for i in range(5)], "grp string, ord int, r double, g double, b double")
    refs = spark.createDataFrame([("a", 0.0, 0.5, 0.5)], "grp string, r double, g double, b double")
    picks = lambda share: [
        (r.grp, r["round"], r["ord"])
        for r in colours.maxmin_pick(cand, refs, ["grp"], "ord", "lab", rounds=2, candidate_block=share).orderBy("round").collect()
    ]
    got = picks(2)
    assert got == picks(100) and got[0] == ("a", 0, 4)
    assert {g for g, _, _ in got} == {"a"}  # a group without references has no pick


def test_roles_absent_and_shown_are_merged(spark):
    """The k first of all roles of the furniture by (mean size or 0, name), for several k."""
    roles = spark.createDataFrame([("f", r, p) for r, p in [("leg", "1"), ("arm", "2"), ("top", "3"), ("back", "8"), ("zip", "9"), ("bar", "1")]], "furniture_id string, role string, part_id string")
    shown = spark.createDataFrame(
        [(1, "f", "1", 4), (1, "f", "2", None), (1, "f", "3", 2), (2, "f", "8", 1), (2, "f", "9", 3), (2, "f", "4", None), (3, "f", "1", 1)],
        "frame int, furniture_id string, part_id string, subasm_size int",
    )
    sizes = {1: {"leg": 4, "bar": 4, "arm": 0, "top": 2}, 2: {"back": 1, "zip": 3}}
    for k in (1, 2, 4, 9):
        got = questions.make_role_questions(roles, shown, ["frame"], k=k).collect()
        every = {"leg", "arm", "top", "back", "zip", "bar"}
        want = {f: sorted(every, key=lambda r: (s.get(r, 0), r))[:k] for f, s in sizes.items()}  # frame 3 shows one part
        picked = lambda f: [r.role for r in sorted((r for r in got if r.frame == f), key=lambda r: r.pick)]
        assert {f: picked(f) for f in want} == want
        assert {r.frame for r in got} == {1, 2}
