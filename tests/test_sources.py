"""File scans, sinks and streams on small hand-made folders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from markwise.operators import graph, media, sampling
from markwise.sources import readers, sinks
from markwise.streaming import live


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def answer(no, shuffle, response, label="A"):
    question = {
        "qid_flat": f"mating/1part/0/Chair/vidA/{no}/{shuffle}", "question_category": "mating", "video_id": "vidA",
        "frame_idx": [3, 9], "question": {"num_options": 4, "correct_option": {"label": label, "raw": ["1", "2"], "idx": 0}},
    }
    return {"conv_id": f"{no}-{shuffle}", "question": question, "response": response, "post_processed_response": "Z"}


def test_responses(spark, tmp_path):
    one = write(tmp_path / "b.jsonl", [answer("001", 0, "A."), "", answer("001", 1, {"response": '{"answer": "B"}', "thoughts": ["t"]})])
    two = write(tmp_path / "a.jsonl", [answer("002", 0, "C")])
    rows = readers.read_responses(spark, paths=f"{one}, ,{two}").orderBy("file_no", "line_no").collect()
    assert [(r.file_no, r.line_no, r.response_text) for r in rows] == [(0, 0, "A."), (0, 2, '{"answer": "B"}'), (1, 0, "C")]
    assert rows[1].thoughts == ["t"]
    tries = readers.attempts(readers.read_responses(spark, path=one)).collect()
    assert {(r.question_no, r.shuff_idx, r.truth) for r in tries} == {("001", 0, "A"), ("001", 1, "A")}
    for bad in ({}, {"path": "x", "paths": "y"}, {"paths": " , "}):
        with pytest.raises(ValueError):
            readers.response_paths(**bad)


def test_jsonl_stream(spark, tmp_path):
    for n, lines in ((10, [{"prompt_frame_idx": 5, "frame_idx": 5}, {"frame_idx": 6}]), (2, [{"frame_idx": 0}, "", "{broken", {"frame_idx": 3}])):
        write(tmp_path / "s" / f"clip_{n}.jsonl", lines)
    schema = "prompt_frame_idx int, frame_idx int"
    out = readers.read_jsonl_stream(spark, str(tmp_path / "s"), schema).orderBy("global_idx").collect()
    assert [(r.file_no, r.local_line, r.global_idx) for r in out] == [(2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3), (10, 0, 4), (10, 1, 5)]
    assert [r.record is None for r in out] == [False, True, True, False, False, False]
    flat = readers.read_jsonl_stream(spark, str(tmp_path / "s"), schema).select("global_idx", "record", "record.*")
    kept = sampling.subsample(flat, 3, sampling.prompt_frame(), valid=F.col("record").isNotNull())
    assert [r.global_idx for r in kept.orderBy("global_idx").collect()] == [0, 3, 4]
    with pytest.raises(Exception, match="broken line"):
        readers.read_jsonl_stream(spark, str(tmp_path / "s"), schema, skip_errors=False).collect()
    (tmp_path / "e").mkdir()
    with pytest.raises(Exception):
        readers.read_jsonl_stream(spark, str(tmp_path / "e"), schema)


def test_yaml_sources(spark, tmp_path):
    source = """
category: Chair
name: c1
video_id: vidA
frame_idx: {frame}
question_category: temporal_loc
template_type: 1part_order
question_params: {{query_part: "1"}}
options: [{{raw: "2"}}, {{raw: "3"}}, {{raw: none}}]
correct_option: {{raw: "2", idx: {idx}}}
jumble_map: [{{a: "1"}}, {{a: "2"}}]
"""
    write(tmp_path / "q" / "010.yaml", [source.format(frame=7, idx=0)])
    write(tmp_path / "q" / "9.yaml", [source.format(frame="[3, 9]", idx="[0, 1]")])
    rows = readers.read_source_questions(spark, str(tmp_path / "q")).orderBy("question_order").collect()
    assert [(r.question_no, r.frame_idx, r.correct_idx) for r in rows] == [("9", [3, 9], [0, 1]), ("010", [7], [0])]
    assert rows[0].options == [[["2"]], [["3"]], [["none"]]] and rows[0].jumble_map == {"a": "2"}
    runs = tmp_path / "runs"
    for name, config in (("r1", "model: {_target_: a.b.qwen_3_vl_hf.Model, model_name: m}\nmedia_cache_dir: /x/sep_keyframe\nnum_shuffles: 0"), ("r2", None), ("videorefer_x", None)):
        write(runs / name / "responses.jsonl", [{}])
        if config:
            write(runs / name / "config.yaml", [config])
    found = {r.run_id: (r.model_name, r.model_key, r.setting, r.num_shuffles) for r in readers.discover_runs(spark, str(runs)).collect()}
    assert found == {"r1": ("m", "qwen_3_vl_hf", "sep_keyframe", 1), "videorefer_x": ("videorefer", "videorefer", "videorefer_videorefer", 1)}
    write(tmp_path / "t" / "base.yaml", ["- {type: video, tag: video, content: '???'}", "- {type: text, tag: question, content: '???'}"])
    assert [(r.template, r.pos, r.tag) for r in readers.read_templates(spark, str(tmp_path / "t")).orderBy("pos").collect()] == [("base", 0, "video"), ("base", 1, "question")]


def test_documents(spark, tmp_path):
    # 4 x 4, left half: runs 0, 8, 8 are coded as "0", "8", "8" -> chr(48), chr(56), chr(56)
    path = write(tmp_path / "m" / "vidA.json", [{"12": {"3": {"size": [4, 4], "counts": "088"}}}])
    r = readers.read_masks(spark, path).first()
    assert (r.video_id, r.frame_idx, r.part_id, r.h, r.w, r.runs) == ("vidA", 12, "3", 4, 4, [0, 8, 8])
    path = write(tmp_path / "a" / "chair.json", [{"annotated_semantics": {"0": "seat"}, "annotated_part_graph": {"0": ["1"]}, "annotated_similar_parts": {}}])
    tables = readers.read_annotations(spark, path)
    assert sorted((x.src, x.dst) for x in tables["part_edge"].collect()) == [("0", "1"), ("1", "0")]
    path = write(tmp_path / "k" / "vidA_frames_metadata.jsonl", [{"frame_time": 1.5}, {"frame_time": 0.5}])
    keys = readers.read_keyframes(spark, path)
    assert sorted((x.video_id, x.keyframe_idx, x.frame_time) for x in keys.collect()) == [("vidA", 0, 1.5), ("vidA", 1, 0.5)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "vidA.mp4").write_bytes(b"xx")
    assert [(x.media_id, x.length) for x in readers.media_inventory(spark, str(tmp_path / "v")).collect()] == [("vidA", 2)]
    agent = tmp_path / "agent"
    write(agent / "001" / "execution_result.json", [{"ok": True, "result": "B", "error": None}])
    write(agent / "001" / "qinfo.json", [{"video_id": "v", "question": {"options": {"4": {"raw": "abstain", "label": "E"}}, "correct_option": {"label": "B"}}}])
    write(agent / "002" / "qinfo.json", [{"video_id": "v"}])
    got = {x.question_no: (x.has_result, x.has_qinfo, x.ok, x.truth, x.abstain_label) for x in readers.read_agent_runs(spark, str(agent)).collect()}
    assert got["001"] == (True, True, True, "B", "E") and got["002"][:3] == (False, True, False)


@pytest.mark.parametrize("style", [{}, {"separators": (",", ":")}, {"indent": 1}])
def test_masks_come_in_pieces(spark, tmp_path, style):
    """A document many splits long is not read as one row; frames without masks and awkward strings do no harm."""
    rng = random.Random(1)
    counts = lambda: "".join(chr(rng.randint(48, 79)) for _ in range(rng.randint(1, 30))) + "\\]"[: rng.randint(0, 1)]
    doc = {str(f): {str(p): {"size": [4, 4], "counts": counts()} for p in range(f % 4)} for f in range(600)}
    for name in ("vidA", "vidB"):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps(doc, **style))
    (tmp_path / "m" / "none.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_masks(spark, str(tmp_path / "m"))
        got = sorted((r.video_id, r.frame_idx, r.part_id, r.h, r.w) for r in rows.collect())
        assert rows.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((v, int(f), p, 4, 4) for v in ("vidA", "vidB") for f, parts in doc.items() for p in parts)


def test_broken_mask_documents_are_an_error(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"1": {"2": {"size": [4, 4], "counts": 7 8}}}')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_masks(spark, str(path)).collect()


def test_questions_and_sinks(spark, tmp_path):
    docs = [{"qid": "x", "frame_idx": 7, "question": {"options": {"1": {"raw": "none", "label": "B"}, "0": {"raw": ["3", "4"], "label": "A"}}}},
            {"qid": "y", "frame_idx": [3, 9]}]
    path = write(tmp_path / "q.jsonl", docs)
    rows = {r.qid: r for r in readers.read_questions(spark, path).collect()}
    assert rows["x"].frame_idx == [7] and rows["y"].frame_idx == [3, 9]
    assert [(o.idx, o.raw_json, o.label) for o in rows["x"].options] == [(0, '["3", "4"]', "A"), (1, "none", "B")]
    df = spark.createDataFrame([("a", 1.0)], "category string, strict double")
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 1
    sinks.write_converted(df, spark.createDataFrame([("1",), ("1",)], "question_no string"), str(tmp_path / "conv"))
    assert spark.read.json(str(tmp_path / "conv" / "issues")).count() == 1


def test_stream_in_several_batches(spark, tmp_path):
    """Transitions and scores over three files equal the batch result; a repeat counts once."""
    src = tmp_path / "in"
    stages = ["a", "a", "v", "i", "i", "a", "v"]
    rows = [("r", t, s, "act", "") for t, s in enumerate(stages)]
    schema = "run_id string, t_ms long, stage string, action string, message string"
    for part in (rows[:2], rows[2:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        live.transition_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    moves = spark.read.parquet(str(tmp_path / "out" / "moves")).orderBy("t_ms").collect()
    assert [(m.from_stage, m.to_stage) for m in moves] == [("a", "v"), ("v", "i"), ("i", "a"), ("a", "v")]
    src = tmp_path / "answers"
    schema = "conv_id string, question_no string, category string, prediction string, truth string"
    for part in ([("1", "q", "m", "A", "A")], [("1", "q", "m", "B", "A"), ("2", "q", "m", "B", "A")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        live.scoreboard_stream(stream, str(tmp_path / "board"), str(tmp_path / "board-state")).awaitTermination()
    row = live.scoreboard(spark, str(tmp_path / "board")).first()
    assert (row.correct, row.incorrect) == (1, 1)


def test_files_keep_their_order(spark, tmp_path, monkeypatch):
    """Relative paths are read in the order given, the files of a folder in natural order."""
    monkeypatch.chdir(tmp_path)
    write(tmp_path / "b.jsonl", [answer("001", 0, "A")])
    write(tmp_path / "a.jsonl", [answer("002", 0, "B")])
    given = [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]
    rows = readers.read_responses(spark, paths=",".join(given)).orderBy("file_no").collect()
    assert [r.response_text for r in rows] == ["A", "B"]
    (tmp_path / "many").mkdir()
    for n in (10, 9, 2):
        write(tmp_path / "many" / f"r{n}.jsonl", [answer("001", 0, f"from {n}")])
    tries = readers.attempts(readers.read_responses(spark, path=str(tmp_path / "many")))
    assert [r.response_text for r in tries.orderBy("ordinal").collect()] == ["from 2", "from 9", "from 10"]


def test_tracks_keep_other_videos(spark, tmp_path):
    path = str(tmp_path / "tracks")
    for video in ("v1", "v2"):
        rows = spark.createDataFrame([(video, 0, 3, "m")], "video_id string, prompt_frame_idx int, frame_idx int, mask string")
        sinks.write_tracks(rows, path)
    assert {r.video_id for r in spark.read.parquet(path).collect()} == {"v1", "v2"}


def test_reversed_and_endless_spans(spark):
    frames = spark.createDataFrame([("k", i) for i in range(12)], "key string, frame_idx long")
    spans = spark.createDataFrame([("k", "9-3", 5.0), ("k", "10-2000000000", 5.0)], "key string, span string, score double")
    kept = media.relevant_frames(frames, spans, ["key"]).select("frame_idx").collect()
    assert sorted(r.frame_idx for r in kept) == [10, 11]


def test_pairs_of_text_ids_sort_by_number(spark):
    pairs = spark.createDataFrame([("g", "10", "9"), ("g", "9", "10")], "g string, src string, dst string")
    parts = spark.createDataFrame([("g", "9"), ("g", "10")], "g string, part_id string")
    assert [(r.src, r.dst) for r in graph.clean_pairs(pairs, parts, ["g"]).collect()] == [("9", "10")]


def test_one_scan_of_many_paths(spark, tmp_path):
    """Files given twice, below a folder and with odd names are read in one scan, each copy numbered for itself."""
    odd = tmp_path / "a+b [c] d%.jsonl"
    odd.write_text("x\ny\n")
    (tmp_path / "plain.jsonl").write_text("z\n")
    literal = str(odd).replace("[", "\\[").replace("]", "\\]")
    lines = readers.numbered_lines(spark, [literal, str(tmp_path), literal])
    assert str(lines._jdf.queryExecution().optimizedPlan()).count("Relation [value") == 1
    got = sorted((r.file_no, r.line_no, r.value) for r in lines.collect())
    assert got == [(0, 0, "x"), (0, 1, "y"), (1, 0, "x"), (1, 0, "z"), (1, 1, "y"), (2, 0, "x"), (2, 1, "y")]
