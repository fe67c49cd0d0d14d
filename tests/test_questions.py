"""Option assembly by case, phrases, validation, shuffles and conversion."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise.functions import rle, text
from markwise.operators import convert, graph, masks, media, questions, render

SCHEMA = """qid string, question_category string, template_type string, kind string, declared string, binary boolean,
  raw_qstr string, correct array<array<array<string>>>, incorrect array<array<array<string>>>"""


def single(*names):
    return [[[n]] for n in names]


def edge(*pairs):
    return [[list(p)] for p in pairs]


def rows(spark, correct, incorrect, n=12, category="mating", template="1part", kind="str", declared="str", binary=False):
    data = [(f"q{i}", category, template, kind, declared, binary, "Which?", correct, incorrect) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def built(df, n=4, **flags):
    return questions.validate_questions(questions.assemble_options(df, n, **flags)).collect()


@pytest.mark.parametrize("c,w", [(0, 2), (0, 5), (1, 1), (1, 2), (1, 3), (1, 6), (2, 0), (2, 1), (2, 3), (3, 0), (3, 2), (5, 5)])
@pytest.mark.parametrize("none_last", [True, False])
def test_cases_are_valid(spark, c, w, none_last):
    df = rows(spark, single(*"123456"[:c]), single(*(f"1{i}" for i in range(w))))
    out = built(df, add_none_at_end=none_last, randomize_options=False)
    for r in out:
        assert r.violations == [] and r.num_options == 4
        labels = [o.label for o in r.options]
        assert labels == list("ABCD") and sum(o.is_correct for o in r.options) == 1
        raws = [o.raw_json for o in r.options]
        assert len(set(raws)) == 4
        if c == 0:
            assert r.correct_option.raw_json == '"none"'
        if none_last and '"none"' in raws:
            assert raws[-1] == '"none"'


def test_order_is_seeded_not_positional(spark):
    df = rows(spark, single("1"), single("2", "3", "4"), n=40)
    one = {r.qid: [o.raw_json for o in r.options] for r in built(df.repartition(7))}
    two = {r.qid: [o.raw_json for o in r.options] for r in built(df.coalesce(1))}
    assert one == two and len({tuple(v) for v in one.values()}) > 5
    other = {r.qid: [o.raw_json for o in r.options] for r in built(df, seed=7)}
    assert other != one


@pytest.mark.parametrize("c,w", [(0, 6), (1, 5), (3, 4)])
def test_random_counts_are_valid(spark, c, w):
    df = rows(spark, single(*"123"[:c]), single(*(f"1{i}" for i in range(w))), n=40)
    out = built(df)
    assert all(r.violations == [] and r.num_options == 4 for r in out)
    assert len({sum(len(o.answers) == 1 for o in r.options) for r in out}) > 1


def test_abstain_comes_last(spark):
    out = built(rows(spark, single("1"), single("2", "3", "4")), add_abstain=True, randomize_options=False)
    assert {r.options[-1].raw_json for r in out} == {'"abstain"'} and {r.num_options for r in out} == {5}


def test_binary(spark):
    df = rows(spark, single("yes"), single("no"), template="2parts", binary=True, n=20)
    out = built(df)
    assert {r.correct_option.text for r in out} == {"Yes"} and {r.num_options for r in out} == {2}
    assert {r.correct_option.label for r in out} == {"A", "B"}
    assert all(r.qstr.startswith("Which?\nOptions:\nA. ") for r in out)


def test_too_few_answers_raise(spark):
    with pytest.raises(Exception, match="do not fill"):
        built(rows(spark, single("1"), []))


def test_combined_phrases(spark):
    r = built(rows(spark, single("1", "2"), single("9"), n=1), randomize_options=False)[0]
    both = [o.text for o in r.options if o.is_correct][0]
    assert both in ("Both Part 1 and Part 2 are correct", "Both Part 2 and Part 1 are correct")
    r = built(rows(spark, edge("12", "34"), edge("56"), kind="list", template="find_edges", n=1), randomize_options=False)[0]
    labels = [o.label for o in r.options if o.raw_json in ('["1", "2"]', '["3", "4"]')]
    assert r.correct_option.text == f"Both Option {labels[0]} and Option {labels[1]} are correct"
    df = rows(spark, edge("12", "34"), edge("56"), kind="list", declared="list", category="temporal_loc", template="1edge_order", n=1)
    r = built(df, randomize_options=False)[0]
    assert "Part ['1', '2']" in r.correct_option.text and "Part 1, Part 2" in [o.text for o in r.options]
    df = rows(spark, single("1", "2", "3"), single("9"), n=1)
    r = built(df, randomize_options=False)[0]
    assert r.correct_option.text.startswith("All of Part") and r.correct_option.text.endswith("and are correct")


@pytest.mark.parametrize("answer,kind,mode,tracking,want", [
    ([["3"]], "str", 1, False, "Part 3"), ([["3"]], "str", 2, False, "Only Part 3"),
    ([["3"]], "str", 3, False, "Only Part 3 is correct"), ([["3", "4"]], "list", 1, False, "Part 3 and Part 4"),
    ([["3", "4", "5"]], "list", 1, False, "Part 3, Part 4 and Part 5"), ([["3", "4"]], "list", 2, False, "Part 3, Part 4"),
    ([["3", "4"], ["5", "6"]], "listoflist", 1, False, "Part 3 and Part 4, Part 5 and Part 6"),
    ([["3", "4"]], "listoflist", 1, True, "Part 3 in Image A matches Part 4 in Image B"),
    ([["3", "4"], ["5", "6"]], "listoflist", 1, True,
     "Part 3 in Image A matches Part 4 in Image B, and Part 5 in Image A matches Part 6 in Image B"),
])
def test_phrases(spark, answer, kind, mode, tracking, want):
    df = spark.createDataFrame([(answer, kind, mode, tracking)], "a array<array<string>>, k string, m int, t boolean")
    got = df.select(text.single_phrase(F.col("a"), F.col("k"), F.col("m"), F.col("t")).alias("x")).first().x
    assert got == want


def test_lexicographic_shuffles(spark):
    df = spark.createDataFrame([(list("wxyz"), [2, 0])], "options array<string>, correct_idx array<int>")
    out = questions.shuffle_options(df, 100).orderBy("shuffle_idx").collect()
    assert ["".join(r.options) for r in out] == ["".join(p) for p in itertools.permutations("wxyz")]
    assert all([r.options[i] for i in r.correct_idx] == ["y", "w"] for r in out)
    with pytest.raises(ValueError):
        questions.shuffle_options(df, 0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Front  left leg", 27, 75.9, "30000/1001")], "t string, i int, s double, f string")
    r = df.select(
        text.erase_positional(F.lower("t")).alias("a"), text.sheet_label(F.col("i")).alias("b"),
        text.time_mark(F.col("s")).alias("c"), text.fraction(F.col("f")).alias("d"),
        text.unadorn(text.adorn(F.lit("C"), "double_square"), "double_square").alias("e"),
        text.time_list(F.array(F.lit(0.5), F.lit(2.0))).alias("g"), text.fraction(F.lit("3:0")).alias("h"),
        text.map_part_ids(F.lit("Part 1 on Part 10, 1"), lambda p: F.create_map(F.lit("1"), F.lit("10"), F.lit("10"), F.lit("1"))[p]).alias("m"),
    ).first()
    assert (r.a, r.b, r.c, r.e, r.g, r.h) == ("leg", "AB", "[01:15]", "C", "0.50s,2.00s", None)
    assert r.d == pytest.approx(29.97, abs=0.01) and r.m == "Part 10 on Part 1, 1"


def test_graph_fixture(spark):
    edges = [("f", a, b) for a, b in (("0", "1"), ("1", "2"))]
    edges = spark.createDataFrame(edges + [(f, b, a) for f, a, b in edges], "furniture_id string, src string, dst string")
    parts = spark.createDataFrame([(1, "f", p, int(p) + 1, 1) for p in ("0", "1", "2", "10")] * 3,
                                  "frame_idx int, furniture_id string, part_id string, area int, subasm_size int")
    pairs = lambda d: sorted((r.src, r.dst) for r in d.collect())
    assert pairs(graph.visible_edges(parts, edges, ["frame_idx"])) == [("0", "1"), ("1", "2")]
    assert pairs(graph.non_edges(parts, edges, ["frame_idx"])) == [("0", "10"), ("0", "2"), ("1", "10"), ("2", "10")]
    assert graph.asymmetric_edges(edges).count() == 0
    top = graph.pick_pairs(parts.distinct(), ["frame_idx"], "size_h2l", 4).orderBy("pick").collect()
    assert [(r.part_a, r.part_b) for r in top] == [("10", "2"), ("10", "1"), ("10", "0"), ("2", "1")]


def test_masks(spark):
    shapes = {"full": [0, 16], "empty": [16], "left": [0, 8, 8], "right": [8, 8], "middle": [4, 8, 4]}
    df = spark.createDataFrame([("v", 0, k, 4, 4, r) for k, r in shapes.items()],
                               "video_id string, frame_idx int, part_id string, h int, w int, runs array<int>")
    area = {r.part_id: r.area for r in masks.with_area(df).collect()}
    assert area == {"full": 16, "empty": 0, "left": 8, "right": 8, "middle": 8}
    for threshold in (0.5, 0.3):
        got = {(r.part_id_a, r.part_id_b): r.iou for r in masks.overlapping_masks(df, df, iou_threshold=threshold, cells=3).collect()}
        want = {}
        pixels = {k: [i % 2 for i, n in enumerate(r) for _ in range(n)] for k, r in shapes.items()}
        for a, b in itertools.product(shapes, shapes):
            common = sum(x & y for x, y in zip(pixels[a], pixels[b]))
            union = sum(x | y for x, y in zip(pixels[a], pixels[b]))
            if union and common / union >= threshold:
                want[(a, b)] = common / union
        assert got == pytest.approx(want)
    back = df.withColumn("b", rle.decode_counts(rle.encode_counts("runs"))).filter("b <> runs")
    assert back.count() == 0
    with pytest.raises(Exception, match="unknown part"):
        masks.part_visibility(df.select("video_id", "frame_idx", F.lit("zz").alias("part_id")), df).collect()
    mapping = spark.createDataFrame([("full", "left"), ("left", "right")], "part_id string, display_id string")
    names = lambda d: sorted(r.part_id for r in masks.remap_parts(df, mapping, d).collect())
    assert names("forward") == ["left", "right"] and names("inverse") == ["full", "left"]


@pytest.mark.parametrize("flags", [{}, {"add_abstain": True, "alphabet": "alpha_lower", "label_style": "double_square", "preprompt": "?", "option_sep": ";"}])
def test_yes_no_questions_equal_the_general_assembly(spark, flags):
    answer = lambda word: [[[word]]]
    rows = [(f"q{i}", "mating", "2parts", "str", "str", True, f"Q {i}?", answer("Yes" if i % 3 else "No"), answer("No" if i % 3 else "Yes")) for i in range(60)]
    df = spark.createDataFrame(rows, "qid string, question_category string, template_type string, kind string, declared string, binary boolean,"
                               " raw_qstr string, correct array<array<array<string>>>, incorrect array<array<array<string>>>")
    names = ["qid", "options", "correct_option", "num_options", "qstr"]
    general = questions.assemble_options(df, 2, 7, **flags).select(*names)
    plain = questions.assemble_yes_no(df.withColumn("truth", F.col("correct")[0][0][0] == "Yes"), 7, **flags).select(*names)
    assert plain.dtypes == general.dtypes
    assert sorted(plain.collect()) == sorted(general.collect())
    assert len({r.correct_option.idx for r in plain.collect()}) == 2


def _hd_masks():
    """Shapes in a full HD frame, as pixel arrays: whole, half, a diagonal, columns far apart, dots, rectangles, and nothing."""
    h, w = 1080, 1920
    y, x = np.mgrid[0:h, 0:w]
    shapes = {
        "whole": x >= 0, "left half": x < w // 2, "left 3/5": x < w * 3 // 5, "diagonal": abs(x * h - y * w) < 40 * w,
        "diagonal'": abs(x * h - y * w) < 60 * w, "columns": x % 960 < 3, "columns'": x % 960 < 4, "dots": (x % 97 == 0) & (y % 89 == 0),
        "corner": (x >= 1900) & (y >= 1070), "corner'": (x >= 1905) & (y >= 1070), "nothing": x < 0, "row": y == 540, "rows": (y == 540) | (y == 541),
    }
    draw = np.random.default_rng(2)
    for i in range(25):
        a, b, c, d = draw.integers(0, 900), draw.integers(0, 400), draw.integers(300, 900), draw.integers(200, 600)
        shapes[f"box {i}"] = (x >= a) & (x < a + c) & (y >= b) & (y < b + d)
    return shapes


def test_masks_of_a_large_frame(spark):
    """Exact overlaps in full HD, and a mask costs a few grid cells whatever its area."""
    shapes = _hd_masks()
    rows = []
    for name, pixels in shapes.items():
        flat = pixels.T.ravel().astype(np.int8)
        turns = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [len(flat)]])
        rows.append(("v", 0, name, 1080, 1920, ([0] if flat[0] else []) + np.diff(turns).tolist()))
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, part_id string, h int, w int, runs array<int>").repartition(3)
    cells = {r.part_id: r.n for r in masks.grid_cells(df, ["part_id"], 0.5).groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cells.keys() == shapes.keys() - {"nothing"}
    assert max(cells.values()) <= 64 and cells["whole"] == 25 and cells["corner"] == 1 and sum(cells.values()) < 12 * len(cells)
    for threshold in (0.5, 0.8):
        got = {(r.part_id_a, r.part_id_b): (r.overlap, r.iou) for r in masks.overlapping_masks(df, df, iou_threshold=threshold).collect()}
        want = {}
        for a, b in itertools.product(shapes, shapes):
            common, union = int((shapes[a] & shapes[b]).sum()), int((shapes[a] | shapes[b]).sum())
            if union and common / union >= threshold:
                want[a, b] = (common, common / union)
        assert got == want and len(got) > len(shapes)


def test_masks_of_other_sizes_never_overlap(spark):
    df = spark.createDataFrame([("v", 0, "a", 2, 2, [0, 4]), ("v", 0, "b", 4, 1, [0, 4])],
                               "video_id string, frame_idx int, part_id string, h int, w int, runs array<int>")
    assert {(r.part_id_a, r.part_id_b) for r in masks.overlapping_masks(df, df).collect()} == {("a", "a"), ("b", "b")}


def test_chat_and_media(spark):
    conv = spark.createDataFrame(
        [("c", 0, "video", "video", "v.mp4"), ("c", 1, "text", "task_instruction", "do"), ("c", 2, "text", "question", "q")],
        "conv_id string, pos int, type string, tag string, content string")
    chat = [(r.message_idx, r.part_idx, r.role, r.content) for r in render.to_chat(conv, slice_rows=2).orderBy("message_idx", "part_idx").collect()]
    assert chat == [(0, 0, "system", "do"), (1, 0, "user", "v.mp4"), (1, 1, "user", "q")]
    frames = spark.createDataFrame([("c", i, f"f{i}") for i in range(3)], "conv_id string, pos long, ref string")
    prompts = spark.createDataFrame([("c", 0, 1, "p0"), ("c", 1, 2, "p1")], "conv_id string, prompt_no int, frame_idx int, ref string")
    refs = lambda d: [r.ref for r in d.orderBy("pos").collect()]
    assert refs(media.concat(frames, prompts)) == ["p1", "p0", "f0", "f1", "f2"]
    assert refs(media.concat(frames, prompts, vid_first=True)) == ["f0", "f1", "f2", "p0", "p1"]
    assert refs(media.embed(frames, prompts)) == ["f0", "p0", "p1"]
    assert media.collage(frames, prompts, "top").first().parts[:2] == ["p0", "p1"]
    third = prompts.unionByName(spark.createDataFrame([("c", 2, 0, "p2")], prompts.schema))
    assert media.collage(frames, third).orderBy("pos").first().parts == ["p0", "p1", "p2", "f0"]
    assert media.collage(frames, third, "bottom").orderBy("pos").first().parts == ["f0", "p0", "p1", "p2"]


def test_positional_and_pairs(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y")], "o int, va string")
    b = spark.createDataFrame([(10, "p"), (9, "q")], "p int, vb string")
    out = convert.zip_by_position(a, b, ["o"], ["p"]).orderBy("position").collect()
    assert [(r.va, r.vb) for r in out] == [("y", "q"), ("x", "p")]
    with pytest.raises(Exception, match="differ in length"):
        convert.zip_by_position(a, b.limit(1), ["o"], ["p"]).collect()
    left = spark.createDataFrame([("k", 1), ("l", 2)], "id string, a int")
    with pytest.raises(Exception, match="one partner"):
        convert.pair_one_to_one(left, spark.createDataFrame([("k", 1)], "id string, b int"), "id").collect()
