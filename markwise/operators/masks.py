"""Masks as rows: visibility, candidate frames, id remapping, overlap joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.functions.rle import leading_box, mask_area, overlap

FRAME = ("video_id", "frame_idx")


def with_area(masks: DataFrame) -> DataFrame:
    return masks.withColumn("area", mask_area(F.col("runs")))


def visible_parts(masks: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Masks that fill more than ``threshold`` of their frame."""
    return with_area(masks).filter(F.col("area") / (F.col("h") * F.col("w")) > threshold)


def part_visibility(
    requests: DataFrame, masks: DataFrame, on: Sequence[str] = (*FRAME, "part_id"),
    threshold: float = 0.0, on_missing: str = "error",
) -> DataFrame:
    """``is_visible`` for each requested part; an unknown part is an error (or null)."""
    known = masks.select(
        *on, (mask_area(F.col("runs")) / (F.col("h") * F.col("w")) > threshold).alias("is_visible")
    )
    out = requests.join(known, list(on), "left")
    if on_missing == "error":
        unknown = F.raise_error(F.lit("visibility of an unknown part")).cast("boolean")
        out = out.withColumn("is_visible", F.coalesce("is_visible", unknown))
    return out


def candidate_frames(
    masks: DataFrame, by: Sequence[str] = FRAME, min_parts: int = 2, min_area: int = 10
) -> DataFrame:
    """Frames with at least ``min_parts`` parts larger than ``min_area``: ``n_parts``."""
    return (
        with_area(masks)
        .filter(F.col("area") > min_area)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_parts"))
        .filter(F.col("n_parts") >= min_parts)
    )


def remap_parts(
    masks: DataFrame, mapping: DataFrame, direction: str, on: Sequence[str] = (),
    applies: str | None = None,
) -> DataFrame:
    """Rename parts by a mapping table (``on``, part_id, display_id).

    ``forward`` shows mask k under ``map[k]``; ``inverse`` shows under k the mask
    of ``map[k]``. Parts without mapping are dropped. With ``applies`` (a boolean
    column, such as "last prompt frame") other rows pass unchanged.
    """
    if direction not in ("forward", "inverse"):
        raise ValueError("direction is 'forward' or 'inverse'")
    old, new = ("part_id", "display_id") if direction == "forward" else ("display_id", "part_id")
    names = mapping.select(*on, F.col(old).alias("part_id"), F.col(new).alias("_new"))
    out = masks.join(names, [*on, "part_id"], "left")
    if applies is None:
        renamed = F.col("_new")
    else:
        renamed = F.when(F.col(applies), F.col("_new")).otherwise(F.col("part_id"))
    return out.withColumn("part_id", renamed).filter("part_id IS NOT NULL").select(*masks.columns)


def grid_cells(
    masks: DataFrame, keep: Sequence[str], iou_threshold: float, cells: int = 8,
) -> DataFrame:
    """``keep`` columns, area, leading box (x0, x1, y0, y1) and one row per cell that this box touches.

    The frame is cut into ``cells`` x ``cells``, whatever its size, so a mask has
    ``cells ** 2`` rows at most. Masks without foreground have none.
    """
    fields = "area long, x0 int, x1 int, y0 int, y1 int"

    rows = masks.select(*keep, "h", "w", "runs")
    fixed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("runs").schema)

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [leading_box(r, h, iou_threshold) for r, h in zip(pdf["runs"], pdf["h"], strict=True)]
            pdf = pdf.drop(columns="runs")[[f is not None for f in found]].reset_index(drop=True)
            box = pd.DataFrame([f for f in found if f], columns=["area", "x0", "x1", "y0", "y1"], dtype="int64")
            yield pd.concat([pdf, box], axis=1)

    rows = rows.mapInPandas(boxes, f"{fixed}, {fields}")
    span = lambda low, high, size: F.sequence(F.expr(f"{low} * {cells} div {size}"), F.expr(f"{high} * {cells} div {size}"))
    return rows.withColumn("cell_x", F.explode(span("x0", "x1", "w"))).withColumn("cell_y", F.explode(span("y0", "y1", "h")))


def overlapping_masks(
    a: DataFrame, b: DataFrame, on: Sequence[str] = FRAME, key: str = "part_id",
    iou_threshold: float = 0.5, cells: int = 8, once: bool = False,
) -> DataFrame:
    """Pairs of masks of one frame with IoU of at least the threshold.

    An IoU of t means that the overlap is at least t of either area. So pairs have
    fitting areas, and the first common column and row lie in both leading boxes. These boxes are
    listed by the cells of a grid over the frame; a pair meets exactly once, in the cell where both boxes have begun.
    Only pairs whose boxes pass fetch their runs. Masks of one frame but of different sizes never overlap.
    Joins are sorted on both sides: the planner takes an array for a few bytes and would broadcast all masks. Runs are dealt
    over all shuffle partitions, as they are many times larger than their compressed files. ``once`` is for a table against
    itself: only pairs whose first key is the lesser.
    """
    if not 0 < iou_threshold <= 1:
        raise ValueError("iou_threshold must be in (0, 1]")

    def prepared(df: DataFrame, side: str) -> DataFrame:
        rows = grid_cells(df, [*on, key], iou_threshold, cells)
        return rows.withColumnsRenamed({c: f"{c}_{side}" for c in (key, "area", "x0", "x1", "y0", "y1")})

    size_fits = (F.col("area_b") >= iou_threshold * F.col("area_a") - 1e-9) & (
        F.col("area_a") >= iou_threshold * F.col("area_b") - 1e-9
    )

    def meets(low: str, high: str, cell: str, size: str):
        begin = F.greatest(f"{low}_a", f"{low}_b")
        return (begin <= F.least(f"{high}_a", f"{high}_b")) & (F.floor(begin * cells / F.col(size)) == F.col(cell))

    first_common = meets("x0", "x1", "cell_x", "w") & meets("y0", "y1", "cell_y", "h")
    pairs = (
        prepared(a, "a").join(prepared(b, "b").hint("merge"), [*on, "h", "w", "cell_x", "cell_y"]).filter(size_fits & first_common)
        .select(*on, f"{key}_a", f"{key}_b", F.col("area_a").alias("_area_a"), F.col("area_b").alias("_area_b"))
    )
    if once:
        pairs = pairs.filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs_a = a.select(*on, F.col(key).alias(f"{key}_a"), F.col("runs").alias("_runs_a"))
    runs_b = b.select(*on, F.col(key).alias(f"{key}_b"), F.col("runs").alias("_runs_b"))
    dealt = lambda runs, own: runs.repartition(parts, *own).hint("merge")
    both = pairs
    for runs, own in ((runs_a, [*on, f"{key}_a"]), (runs_b, [*on, f"{key}_b"])):
        both = both.join(dealt(runs, own), own)
    kept = [*on, f"{key}_a", f"{key}_b"]
    fields = ", ".join(f"{c} {dict(both.dtypes)[c]}" for c in kept)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["overlap"] = [overlap(x, y) for x, y in zip(pdf["_runs_a"], pdf["_runs_b"])]
            pdf["iou"] = pdf["overlap"] / (pdf["_area_a"] + pdf["_area_b"] - pdf["overlap"])
            yield pdf.loc[pdf["iou"] >= iou_threshold, [*kept, "overlap", "iou"]]

    return both.mapInPandas(verify, f"{fields}, overlap long, iou double")
