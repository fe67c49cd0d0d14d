"""Union and complement of intervals per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.operators import ordered
from markwise.operators.ordered import lay_out


def normalise_intervals(
    df: DataFrame, start: str = "start", end: str = "end", total: Column | None = None, eps: float = 1e-9
) -> DataFrame:
    """Swap reversed ends, clamp to ``[0, total]``, drop intervals not longer than ``eps``."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    if total is not None:
        lo = F.greatest(F.lit(0), F.least(lo, total))
        hi = F.greatest(F.lit(0), F.least(hi, total))
    return df.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_hi") - F.col("_lo") > eps).withColumns(
        {start: F.col("_lo"), end: F.col("_hi")}
    ).drop("_lo", "_hi")


def merge_intervals(
    df: DataFrame,
    by: Sequence[str],
    start: str = "start",
    end: str = "end",
    eps: float = 1e-9,
    slice_rows: int | None = None,
) -> DataFrame:
    """Disjoint cover of normalised intervals; touching ones (within ``eps``) join.

    Copies of an interval and intervals with the same start are reduced to the
    longest before the shuffle.
    """
    longest = df.groupBy(*by, start).agg(F.max(end).alias(end))
    laid = (
        lay_out(longest, by, [start], slice_rows)
        .scan(_reach=ordered.running_max(F.col(end), exclusive=True))
        .then(
            lambda d: d.withColumn(
                "_new",
                (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + eps)).cast("int"),
            )
        )
        .scan(_island=ordered.running_sum(F.col("_new")))
    )
    return (
        laid.rows()
        .groupBy(*by, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def invert_intervals(
    merged: DataFrame,
    totals: DataFrame,
    by: Sequence[str],
    total: str,
    start: str = "start",
    end: str = "end",
    eps: float = 1e-9,
    require: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """What merged intervals leave of ``[0, total]``; ``totals`` has one row per key.

    With ``require`` a key of which nothing is left is an error.
    """
    edges = merged.select(*by, F.col(end).alias("_from"), F.col(start).alias("_until"))
    # The head row (end 0, no start) and the tail row (start total) close each key.
    head = totals.select(*by, F.lit(0).alias("_from"), F.lit(None).alias("_until"))
    tail = totals.select(*by, F.lit(None).alias("_from"), F.col(total).alias("_until"))
    rows = edges.unionByName(head).unionByName(tail).withColumn(
        "_at", F.coalesce("_until", F.lit(-1))
    ).withColumn("_tail", F.col("_from").isNull().cast("int"))
    left = (
        lay_out(rows, by, ["_at", "_tail"], slice_rows)
        .scan(_next=ordered.lead(F.col("_until")))
        .rows()
        .filter((F.col("_next") - F.col("_from")) > eps)
        .select(*by, F.col("_from").alias(start), F.col("_next").alias(end))
    )
    if require:
        missing = F.raise_error(F.lit("no interval is left"))
        kind = left.schema[start].dataType
        left = totals.select(*by).join(left, list(by), "left").withColumn(
            start, F.coalesce(start, missing.cast(kind))
        )
    return left


def kept_ranges(
    removed: DataFrame,
    totals: DataFrame,
    by: Sequence[str],
    total: str,
    before: Column | None = None,
    after: Column | None = None,
    start: str = "start",
    end: str = "end",
    eps: float = 1e-9,
    require: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """What is left of ``[0, total]`` without the removed ranges, the head up to ``before`` and the tail from ``after``.

    ``before`` and ``after`` are columns of ``totals`` (null: nothing is removed there). Ranges may be reversed, overlap or
    reach beyond the ends; ranges of keys without a total are ignored.
    """
    kind = totals.schema[total].dataType
    ranges = [removed.select(*by, F.col(start).cast(kind).alias(start), F.col(end).cast(kind).alias(end)).join(totals.select(*by, F.col(total).alias("_total")), list(by))]
    for low, high, given in ((F.lit(0), before, before), (after, F.col(total), after)):
        if given is not None:
            ranges.append(totals.filter(given.isNotNull()).select(
                *by, low.cast(kind).alias(start), high.cast(kind).alias(end), F.col(total).alias("_total")
            ))
    every = ranges[0]
    for more in ranges[1:]:
        every = every.unionByName(more)
    clean = normalise_intervals(every, start, end, F.col("_total"), eps).drop("_total")
    merged = merge_intervals(clean, by, start, end, eps, slice_rows)
    return invert_intervals(merged, totals, by, total, start, end, eps, require, slice_rows)
