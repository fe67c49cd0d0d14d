"""What large tables need of a plan: nothing large is broadcast, and no table of few bytes is worked on in one task."""

from pyspark.sql import functions as F

from markwise.operators import graph, masks, questions
from markwise.plans import authoring, feeds
from markwise.sources import readers
from markwise.streaming import live
from tests.test_streaming import EVENT, event, feed, moves

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_never_broadcast(spark):
    """Arrays look small to the planner, however long they are; all were sent to the driver."""
    rows = spark.createDataFrame([(0, p, 4, 4, [p, 8, 8 - p]) for p in range(3)], "frame int, part_id int, h int, w int, runs array<int>")
    both = masks.overlapping_masks(rows, rows, ["frame"], iou_threshold=0.5)
    once = masks.overlapping_masks(rows, rows, ["frame"], iou_threshold=0.5, once=True)
    assert "Broadcast" not in plan(both) and "Broadcast" not in plan(once)
    assert sorted(once.collect()) == sorted(both.filter(F.col("part_id_a") < F.col("part_id_b")).collect()) != []

def no_planned_broadcast(spark, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vocabulary_is_broadcast(spark):
    """A shuffle by furniture and part has as few tasks with rows as there are parts."""
    shown = spark.createDataFrame([(0, "w", str(p), 1, p) for p in range(4)], "frame int, furniture_id string, part_id string, subasm_size int, area int")
    edges = spark.createDataFrame([("w", "0", "1"), ("w", "1", "0")], "furniture_id string, src string, dst string")
    roles = spark.createDataFrame([("w", "0", "leg"), ("w", "1", "top")], "furniture_id string, part_id string, role string")
    builds = [
        lambda: graph.visible_edges(shown, edges, ["frame"]), lambda: graph.with_neighbours(shown, edges, ["frame"]),
        lambda: questions.make_2part(shown, edges, ["frame"]), lambda: questions.make_role_questions(roles, shown, ["frame"], k=1),
    ]
    assert all("BroadcastHashJoin" in no_planned_broadcast(spark, build) for build in builds)


def test_roles_of_the_vocabulary_hold_for_every_frame(spark):
    shown = spark.createDataFrame([(0, "a", 2), (0, "b", 4), (1, "a", 6)], "frame int, part_id string, subasm_size int")
    roles = spark.createDataFrame([("a", "leg"), ("b", "leg")], "part_id string, role string")
    got = questions.role_sizes(roles, shown, ["frame"]).collect()
    assert sorted(map(tuple, got)) == [(0, "leg", 3.0, 2, 2), (1, "leg", 6.0, 6, 1)]


def test_questions_of_a_small_file_are_spread(spark):
    assert "hashpartitioning(p_partkey" in plan(authoring.annotated(spark, SF))


def test_annotations_by_line(spark, tmp_path):
    line = '{"furniture_id": "%s", "annotated_semantics": {"1": "leg"}, "annotated_part_graph": {"1": ["2"]}, "annotated_similar_parts": {}}\n'
    (tmp_path / "all.json").write_text(line % "a" + line % "b")
    found = readers.read_annotations(spark, str(tmp_path), lines=True)
    assert sorted(map(tuple, found["part"].collect())) == [("a", "1", "leg"), ("b", "1", "leg")]
    assert sorted(map(tuple, found["part_edge"].collect())) == [(f, *e) for f in "ab" for e in (("1", "2"), ("2", "1"))]


def test_mask_documents_do_not_grow_with_the_table(spark, monkeypatch):
    seen, read = [], readers.read_masks
    monkeypatch.setattr(readers, "read_masks", lambda s, path: (seen.append(path), read(s, path))[1])
    feeds.source_masks(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert spark.read.text(seen[0]).count() == lines.select(F.col("l_suppkey") % 20, "l_orderkey").distinct().count()


def test_runs_share_state(spark, tmp_path):
    """All runs in one share: each still goes on from its own last event, late and repeated ones included."""
    parts = [
        [event("a", 0, "x"), event("b", 1, "p"), event("a", 20, "y")], [event("b", 15, "q"), event("b", 15, "q"), event("a", 40, "z")],
        [event("b", 45, "p"), event("end", 100, "x")], [event("end", 101, "y")],
    ]
    feed(spark, tmp_path, EVENT, parts, lambda rows, path, state: live.ordered_transition_stream(rows, path, state, shares=1))
    got = moves(spark.read.parquet(str(tmp_path / "out")))
    assert [(r, t // 60_000, a, b) for r, t, a, b, _ in got] == [("a", 20, "x", "y"), ("a", 40, "y", "z"), ("b", 15, "p", "q"), ("b", 45, "q", "p")]
