"""Writes of responses, manifests, tracks, reports and converted sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.session import settle
from markwise.sources.schemas import MANIFEST_NULLABLE

CLIP_FRAMES = 256


def append_rows(df: DataFrame, path: str, by: Sequence[str] = ("run_id",), format: str = "json") -> None:
    """Append answers below their run; readers of other runs skip the new files."""
    df.write.mode("append").partitionBy(*by).format(format).save(path)


def replace_rows(df: DataFrame, path: str, format: str = "json") -> None:
    """Write an upserted set to a new path; the caller swaps the paths when it is complete."""
    df.write.mode("errorifexists").format(format).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A result table as one CSV file; it has one row per category or run."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_tracks(df: DataFrame, path: str, clip_frames: int = CLIP_FRAMES, format: str = "parquet") -> None:
    """Mask tracks by video, prompt frame and clip (``frame_idx div clip_frames``); clips not in ``df`` stay as stored."""
    clip = F.floor(F.col("frame_idx") / clip_frames)
    keys = ["video_id", "prompt_frame_idx", "clip_idx"]
    rows = df.withColumn("clip_idx", clip)
    # One task per clip of a track: a long track spreads over its clips.
    rows.repartition(*keys).sortWithinPartitions(*keys, "frame_idx").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys).format(format).save(path)


def write_converted(df: DataFrame, issues: DataFrame, path: str) -> None:
    """Converted questions and the questions with visibility issues, beside each other."""
    settle(df).write.mode("overwrite").json(f"{path}/questions")
    issues.select("question_no").distinct().write.mode("overwrite").json(f"{path}/issues")


def write_manifest_csv(df: DataFrame, path: str) -> None:
    """Frame manifest with -1 for null."""
    nullable = [c for c in MANIFEST_NULLABLE if c in df.columns]
    df.na.fill(-1, subset=nullable).write.mode("overwrite").csv(path, header=True)
