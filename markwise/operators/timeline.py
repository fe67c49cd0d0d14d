"""Joins and rewrites along an ordered time axis, per key.

Times may be integers or doubles. Everything is built on the ordered scans, so
one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.operators import ordered
from markwise.operators.ordered import Laid, lay_out


def _merged(
    points: DataFrame, queries: DataFrame, by: Sequence[str], ts: str, query_ts: str, query_id: str
) -> DataFrame:
    """Points and queries in one table; a point sorts before a query of the same time.

    ``points`` must be unique on (by, ts).
    """
    id_type = queries.schema[query_id].dataType
    left = points.select(
        *by,
        F.col(ts).alias("_t"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast(id_type).alias("_id"),
        F.struct(*[c for c in points.columns if c not in by]).alias("_point"),
    )
    right = queries.select(
        *by,
        F.col(query_ts).alias("_t"),
        F.lit(1).alias("_kind"),
        F.col(query_id).alias("_id"),
        F.struct(*[c for c in queries.columns if c not in by]).alias("_query"),
    )
    return left.unionByName(right, allowMissingColumns=True)


def asof_index(
    timeline: DataFrame,
    queries: DataFrame,
    by: Sequence[str],
    ts: str,
    index: str,
    query_ts: str,
    query_id: str,
    mode: str = "nearest",
    on_empty: str = "error",
    slice_rows: int | None = None,
) -> DataFrame:
    """Position on the timeline for each query time: ``matched_idx, matched_ts``.

    ``floor``: last point at or before, clipped to the first. ``ceil``: first
    point at or after, clipped to the last. ``nearest``: smallest distance, the
    earlier point on ties. Points that share a time are reduced to their first
    and last index before the shuffle. A query without any timeline is an error,
    or null with ``on_empty='null'``.
    """
    points = timeline.groupBy(*by, ts).agg(
        F.min(index).alias("_lo"), F.max(index).alias("_hi")
    ).withColumnRenamed(ts, "_at")
    found = (
        lay_out(_merged(points, queries, by, "_at", query_ts, query_id), by, ["_t", "_kind", "_id"], slice_rows)
        .scan(
            _prev=ordered.last_value(F.col("_point")),
            _next=ordered.next_value(F.col("_point"), exclusive=True),
        )
        .rows()
        .filter("_kind = 1")
    )
    prev, nxt, at = F.col("_prev"), F.col("_next"), F.col("_t")
    hit = prev["_at"] == at
    if mode == "floor":
        idx = F.coalesce(prev["_hi"], nxt["_lo"])
        when = F.coalesce(prev["_at"], nxt["_at"])
    elif mode == "ceil":
        idx = F.when(hit, prev["_lo"]).otherwise(F.coalesce(nxt["_lo"], prev["_hi"]))
        when = F.when(hit, prev["_at"]).otherwise(F.coalesce(nxt["_at"], prev["_at"]))
    elif mode == "nearest":
        later = nxt.isNotNull() & (prev.isNull() | (nxt["_at"] - at < at - prev["_at"]))
        idx = F.when(later, nxt["_lo"]).otherwise(prev["_lo"])
        when = F.when(later, nxt["_at"]).otherwise(prev["_at"])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if on_empty == "error":
        empty = F.raise_error(F.lit("as-of lookup on an empty timeline"))
        idx = F.when(prev.isNull() & nxt.isNull(), empty.cast("long")).otherwise(idx)
    return found.select(
        *by, "_query.*", idx.alias("matched_idx"), when.alias("matched_ts")
    )


def find_gaps(
    df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], delta: float = 1.0,
    slice_rows: int | None = None,
) -> DataFrame:
    """Pairs of neighbouring times more than ``delta`` apart: ``gap_start, gap_end``."""
    rows = lay_out(df.select(*by, ts, *tie), by, [ts, *tie], slice_rows).scan(
        _next=ordered.lead(F.col(ts))
    ).rows()
    return rows.filter(F.col("_next") - F.col(ts) > delta).select(
        *by, F.col(ts).alias("gap_start"), F.col("_next").alias("gap_end")
    )


def compact_time(
    df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], delta: float = 1.0,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ``compact_ts``: time from the first row with all earlier gaps cut out."""
    step = F.col(ts) - F.col("_before")
    gap = F.when(step > delta, step).otherwise(F.lit(0))
    return (
        lay_out(df, by, [ts, *tie], slice_rows)
        .scan(_before=ordered.lag(F.col(ts)))
        .then(lambda d: d.withColumn("_gap", gap))
        .scan(
            _cut=ordered.running_sum(F.col("_gap")),
            # ascending order, so the largest of -t is the first t
            _first=ordered.running_max(-F.col(ts)),
        )
        .rows()
        .withColumn("compact_ts", F.col(ts) + F.col("_first") - F.col("_cut"))
        .drop("_before", "_gap", "_cut", "_first")
    )


def assign_interval(
    frames: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    ts: str,
    frame_id: str,
    start: str,
    end: str,
    eps: float = 0,
    closed_start: bool = True,
    slice_rows: int | None = None,
) -> DataFrame:
    """Frames with the interval that holds them (its columns null where none).

    The intervals of a key must not overlap, so the one to test is the last one
    that starts at or before the frame: a floor match, not a range join.
    ``[start - eps, end - eps)``, or open at both ends without ``closed_start``.
    """
    points = intervals.withColumn("_from", F.col(start) - F.lit(eps))
    found = (
        lay_out(_merged(points, frames, by, "_from", ts, frame_id), by, ["_t", "_kind", "_id"], slice_rows)
        .scan(
            _here=ordered.last_value(F.col("_point")),
        )
        .rows()
        .filter("_kind = 1")
    )
    here, at = F.col("_here"), F.col("_t")
    after_start = at >= here["_from"] if closed_start else at > here["_from"]
    inside = after_start & (at < here[end] - F.lit(eps))
    extra = [c for c in intervals.columns if c not in by]
    return found.select(
        *by, "_query.*", *[F.when(inside, here[c]).alias(c) for c in extra]
    )


def drop_in_gaps(
    frames: DataFrame, gaps: DataFrame, by: Sequence[str], ts: str, frame_id: str,
    start: str = "gap_start", end: str = "gap_end", slice_rows: int | None = None,
) -> DataFrame:
    """Frames that are not strictly inside a gap ``(start, end)``."""
    tagged = assign_interval(
        frames, gaps.select(*by, start, end), by, ts, frame_id, start, end,
        closed_start=False, slice_rows=slice_rows,
    )
    return tagged.filter(F.col(start).isNull()).drop(start, end)


def strictly_increasing(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str,
    slice_rows: int | None = None,
) -> DataFrame:
    """``out_k = max(value_k, out_{k-1} + 1)`` in closed form.

    Subtracting the row position turns the recurrence into a prefix maximum.
    """
    return _increasing(lay_out(df, by, order, slice_rows), value, out).rows()


def _increasing(laid: Laid, value: str, out: str) -> Laid:
    return (
        laid.scan(_k=ordered.ordinal())
        .scan(_top=ordered.running_max(F.col(value) - F.col("_k")))
        .then(lambda d: d.withColumn(out, F.col("_top") + F.col("_k")).drop("_k", "_top"))
    )


def match_exclusive(
    prompts: DataFrame,
    frames: DataFrame,
    by: Sequence[str],
    ts: str,
    index: str,
    prompt_ts: str,
    prompt_id: str,
    slice_rows: int | None = None,
) -> DataFrame:
    """Prompts in time order take the first unused frame at or after their time.

    ``frames[index]`` is the 0-based frame position. Gives ``matched_idx``;
    prompts that run past the last frame are dropped. The greedy rule is the
    strictly increasing repair of each prompt's first candidate.
    """
    points = frames.groupBy(*by, ts).agg(F.min(index).alias("_lo")).withColumnRenamed(ts, "_at")
    last = frames.groupBy(*by).agg(F.max(index).alias("_last"))
    found = (
        lay_out(
            _merged(points, prompts, by, "_at", prompt_ts, prompt_id), by, ["_t", "_kind", "_id"], slice_rows
        )
        .scan(
            _prev=ordered.last_value(F.col("_point")),
            _next=ordered.next_value(F.col("_point"), exclusive=True),
        )
        .then(lambda d: d.filter("_kind = 1"))
        .then(
            lambda d: d.withColumn(
                "_first",
                F.when(F.col("_prev._at") == F.col("_t"), F.col("_prev._lo")).otherwise(
                    F.col("_next._lo")
                ),
            ).filter("_first IS NOT NULL")
        )
    )
    # A prompt without any candidate has none after it either, so dropping those first is safe.
    repaired = _increasing(found, "_first", "matched_idx").rows()
    return (
        repaired.join(last, list(by))
        .filter(F.col("matched_idx") <= F.col("_last"))
        .select(*by, "_query.*", "matched_idx")
    )


def frames_between(
    df: DataFrame, ts: str, start: float, end: float | None = None, delta: float | None = None
) -> DataFrame:
    """Rows of the half-open interval ``[start, end)``; no end means to the last row."""
    if delta is not None and end is not None:
        raise ValueError("give end or delta, not both")
    if delta is not None:
        end = start + delta
    keep: Column = F.col(ts) >= start
    if end is not None:
        keep = keep & (F.col(ts) < end)
    return df.filter(keep)


def frame_time_bounds(df: DataFrame, by: Sequence[str], ts: str, line: str) -> DataFrame:
    """First and last frame time in file order (not the smallest and largest)."""
    return df.groupBy(*by).agg(
        F.min_by(ts, line).alias("first_ts"), F.max_by(ts, line).alias("last_ts")
    )


def map_to_raw(
    requests: DataFrame, keyframes: DataFrame, frames: DataFrame, by: Sequence[str],
    request_id: str, keyframe_idx: str, keyframe_ts: str, ts: str, frame_idx: str,
    trimmed_delta: float | None = None,
) -> DataFrame:
    """Raw frame for each requested key-frame; one row per request.

    With ``trimmed_delta`` the frame times are those of a video whose gaps were
    cut, so the key-frame times are compacted in the same way first.
    """
    if trimmed_delta is not None:
        keyframes = compact_time(keyframes, by, keyframe_ts, [keyframe_idx], trimmed_delta)
        keyframe_ts = "compact_ts"
    asked = requests.join(
        keyframes.select(*by, keyframe_idx, F.col(keyframe_ts).alias("_want")), [*by, keyframe_idx], "left"
    ).withColumn(
        "_want",
        F.coalesce("_want", F.raise_error(F.lit("request for an unknown key-frame")).cast("double")),
    )
    return asof_index(
        frames, asked, by, ts, frame_idx, "_want", request_id, mode="nearest"
    ).drop("_want")


def look_up_keyframes(
    requests: DataFrame, frames: DataFrame, by: Sequence[str], keyframe: str, index: str,
    is_prompt: Column | None = None, on_problem: str = "error", out: str = "frame_pos",
) -> DataFrame:
    """Position in the sub-sampled video of each requested key-frame.

    ``frames`` are the frames that were kept, with their new ``index``; only prompt frames count. A key-frame that was not
    kept, or was kept more than once, is an error that names it, or null with ``on_problem='null'`` (``problem`` says which).
    Frames are counted before they meet the requests, so the join can't multiply rows.
    """
    if on_problem not in ("error", "null"):
        raise ValueError("on_problem is 'error' or 'null'")
    asked = [*by, keyframe]
    known = frames.filter(F.col(keyframe).isNotNull() if is_prompt is None else is_prompt & F.col(keyframe).isNotNull())
    known = known.groupBy(*asked).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias("_index"))
    found = requests.join(known, asked, "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    where = F.concat_ws("/", *[F.col(c).cast("string") for c in asked])
    position = F.when(problem.isNull(), F.col("_index"))
    if on_problem == "null":
        return found.select(*requests.columns, position.alias(out), problem.alias("problem"))
    failed = F.raise_error(F.concat(problem, F.lit(" key-frame "), where)).cast(frames.schema[index].dataType)
    return found.select(*requests.columns, F.when(problem.isNotNull(), failed).otherwise(position).alias(out))
