"""Media recipes on the frame manifest.

A manifest has one row per output frame (``by``, pos, ref); prompts are
(``by``, prompt_no, frame_idx, ref). Steps are DataFrame functions; a recipe
runs them in order and keys its rows by the steps' parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions.ids import recipe_key
from markwise.operators.sampling import with_position

Step = tuple[str, Callable[[DataFrame], DataFrame], Mapping]


def embed(manifest: DataFrame, prompts: DataFrame, by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Frames that are prompt frames show the prompt instead."""
    shown = prompts.select(*by, F.col("frame_idx").alias("pos"), F.col("ref").alias("_prompt"))
    return manifest.join(shown, [*by, "pos"], "left").withColumn("ref", F.coalesce("_prompt", "ref")).drop("_prompt")


def _prompt_list(prompts: DataFrame, by: Sequence[str]) -> DataFrame:
    return prompts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("prompt_no", "ref"))), lambda p: p["ref"]).alias("_prompts")
    )


def collage(
    manifest: DataFrame, prompts: DataFrame, pos: str = "left", by: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Every frame with all prompts beside it: ``parts`` in reading order."""
    if pos not in ("left", "right", "top", "bottom"):
        raise ValueError(f"unknown position {pos!r}")
    out = manifest.join(_prompt_list(prompts, by), list(by), "left")
    shown = F.coalesce("_prompts", F.expr("cast(array() as array<string>)"))
    frame = F.array("ref")
    parts = F.concat(shown, frame) if pos in ("left", "top") else F.concat(frame, shown)
    return out.withColumn("parts", parts).drop("_prompts")


def concat(
    manifest: DataFrame, prompts: DataFrame, vid_first: bool = False, by: Sequence[str] = ("conv_id",),
    slice_rows: int | None = None,
) -> DataFrame:
    """Prompts before or after the video, re-indexed.

    Each prompt is put in front of all that is there, so several come out in
    reverse order.
    """
    order = F.col("prompt_no") if vid_first else -F.col("prompt_no")
    extra = prompts.select(
        *by, F.lit(1 if vid_first else -1).alias("_part"), order.cast("long").alias("_key"), "ref"
    )
    body = manifest.select(*by, F.lit(0).alias("_part"), F.col("pos").cast("long").alias("_key"), "ref")
    out = with_position(extra.unionByName(body), by, ["_part", "_key"], "pos", slice_rows=slice_rows)
    return out.select(*by, "pos", "ref")


def number_frames(manifest: DataFrame, zero_index: bool = True) -> DataFrame:
    """Number shown on each frame, from its dense position."""
    return manifest.withColumn("frame_label", (F.col("pos") + (0 if zero_index else 1)).cast("string"))


def run_recipe(
    manifest: DataFrame, steps: Sequence[Step], cache: DataFrame | None = None, source: Column | None = None,
    key: str = "media_key",
) -> DataFrame:
    """Apply the steps in order; rows carry the content key of source and parameters.

    With ``cache`` (a table of stored keys) rows already built are left out
    before any step runs.
    """
    params = recipe_key({"pipeline": [{"name": name, **params} for name, _, params in steps]})
    source = F.col("conv_id") if source is None else source
    stamp = lambda df: df.withColumn(key, F.sha2(F.concat_ws("|", source, F.lit(params)), 256))
    rows = stamp(manifest)
    if cache is not None:
        rows = rows.join(cache.select(key).distinct(), key, "left_anti")
    out = reduce(lambda df, step: df.transform(step[1]), steps, rows.drop(key))
    return stamp(out)


def relevant_frames(
    frames: DataFrame, scores: DataFrame, by: Sequence[str], threshold: float = 4, offset: int = 0,
    index: str = "frame_idx", clip: str | None = None,
) -> DataFrame:
    """Frames a model found relevant, per key; all frames if none is left.

    ``scores``: by[, clip], span (``"7"`` or ``"3-9"``), score. Spans are inclusive
    and start no earlier than ``offset``. A clip without any score counts as
    fully relevant; a reversed span holds nothing. A span is cut to the frames its key
    has before its indices are expanded for an equality join.
    """
    key = [*by, clip] if clip else list(by)
    ends = F.split("span", "-")
    low = F.greatest(ends[0].cast("long"), F.lit(offset))
    high = F.element_at(ends, -1).cast("long")
    reach = frames.groupBy(*key).agg(F.min(index).alias("_first"), F.max(index).alias("_last"))
    spans = scores.filter(F.col("score") >= threshold).select(*key, low.alias("_low"), high.alias("_high")).join(reach, key)
    spans = spans.select(*key, F.greatest("_low", "_first").alias("_low"), F.least("_high", "_last").alias("_high"))
    good = spans.filter("_low <= _high").select(*key, F.explode(F.sequence("_low", "_high")).alias(index)).distinct()
    scored = scores.select(*key).distinct().withColumn("_scored", F.lit(True))
    tagged = (
        frames.join(good.withColumn("_good", F.lit(True)), [*key, index], "left")
        .join(scored, key, "left")
        .withColumn("_keep", F.coalesce("_good", F.col("_scored").isNull() & (F.col(index) >= offset)))
    )
    some = tagged.groupBy(*by).agg(F.max("_keep").alias("_any"))
    return tagged.join(some, list(by)).filter(F.col("_keep") | ~F.col("_any")).drop(
        "_good", "_scored", "_keep", "_any"
    )
