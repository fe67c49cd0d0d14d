"""Run-length masks: column-major runs, background first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from markwise.functions.text import let


def mask_area(runs: Column) -> Column:
    """Foreground pixels: the runs at odd positions."""
    return F.aggregate(
        F.transform(runs, lambda r, i: F.when(i % 2 == 1, r).otherwise(0)),
        F.lit(0).cast("long"),
        lambda acc, r: acc + r,
    )


def empty_runs(h: Column, w: Column) -> Column:
    """Runs of a mask without foreground."""
    return F.array((h * w).cast("int"))


def runs_from_bits(bits: Column) -> Column:
    """Runs of an array of 0/1 pixels in column-major order."""

    def runs(b: Column) -> Column:
        size = F.size(b)
        turns = F.filter(F.sequence(F.lit(1), size - 1), lambda i: F.get(b, i) != F.get(b, i - 1))
        return let(
            turns,
            lambda t: F.concat(
                F.when(F.get(b, F.lit(0)) == 1, F.array(F.lit(0))).otherwise(F.slice(F.array(F.lit(0)), 1, 0)),
                F.zip_with(
                    F.concat(t, F.array(size)), F.concat(F.array(F.lit(0)), t), lambda e, s: (e - s).cast("int")
                ),
            ),
        )

    return let(bits, runs)


def _spans(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end pixel of each foreground run."""
    ends = np.cumsum(runs)
    return (ends - runs)[1::2], ends[1::2]


def _filled_before(runs: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Foreground pixels before each given pixel; piecewise linear, so interpolated."""
    ends = np.concatenate([[0], np.cumsum(runs)])
    filled = np.concatenate([[0], np.cumsum(np.where(np.arange(len(runs)) % 2 == 1, runs, 0))])
    return np.rint(np.interp(pixels, ends, filled)).astype(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common foreground pixels of two masks of one size."""
    start, stop = _spans(np.asarray(a, dtype=np.int64))
    b = np.asarray(b, dtype=np.int64)
    return int((_filled_before(b, stop) - _filled_before(b, start)).sum())


def _leading(mass: np.ndarray, least: float) -> tuple[int, int]:
    """First filled place, and the last one from which on at least ``least`` still follows."""
    following = mass[::-1].cumsum()[::-1]
    return int(np.argmax(mass > 0)), int(np.flatnonzero(following >= least - 1e-9)[-1])


def leading_box(runs: np.ndarray, height: int, share: float) -> tuple[int, int, int, int, int] | None:
    """Area and leading box (x0, x1, y0, y1) of a mask; None without foreground.

    The box runs from the first filled column (and row) to the last from which on
    ``share`` of the area still follows. The first column (row) that two masks have in common lies
    in it for both if their overlap is at least that share of both areas.
    """
    runs = np.asarray(runs, dtype=np.int64)
    start, stop = _spans(runs)
    start, stop = start[stop > start], stop[stop > start] - 1
    if not len(start):
        return None
    columns = np.diff(_filled_before(runs, np.arange(runs.sum() // height + 1) * height))
    across = stop // height - start // height
    turns = np.bincount(start % height, minlength=height + 1) - np.bincount(stop % height + 1, minlength=height + 1)
    turns[0] += across.sum()  # a run over a column's end goes on at the top of the next
    area = int((stop - start + 1).sum())
    return area, *_leading(columns, share * area), *_leading(turns[:height].cumsum(), share * area)


@F.pandas_udf(ArrayType(IntegerType()))
def decode_counts(counts: pd.Series) -> pd.Series:
    """Runs from the compressed counts string of the COCO mask format.

    Each number is written in 5-bit groups, lowest first, 48 added to make them
    printable; from the third run on the value is a difference to the run two before.
    """

    def one(text):
        runs, value, shift = [], 0, 0
        for code in text.encode("ascii"):
            group = code - 48
            value |= (group & 31) << shift
            shift += 5
            if not group & 32:
                if group & 16:
                    value -= 1 << shift
                runs.append(value + (runs[-2] if len(runs) > 2 else 0))
                value = shift = 0
        return runs

    return counts.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def encode_counts(runs: pd.Series) -> pd.Series:
    """The inverse of :func:`decode_counts`."""

    def one(values):
        out = []
        for i, run in enumerate(values):
            rest = int(run) - (int(values[i - 2]) if i > 2 else 0)
            while True:
                group, rest = rest & 31, rest >> 5
                more = rest != (-1 if group & 16 else 0)
                out.append(chr(group + 48 + (32 if more else 0)))
                if not more:
                    break
        return "".join(out)

    return runs.map(one, na_action="ignore")
