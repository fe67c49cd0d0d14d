"""Ordered scans that do not put one key into one task.

A window partitioned by a key sends every row of that key to one task, which
fails when a single video, run or user holds a large share of the table. Here
the rows of such a key are cut into contiguous ranges of ``order`` ("slices"). Each scan runs an ordinary window
inside ``(key, slice)`` and adds what the earlier (or later) slices of the same
key contribute.

Where a key is cut is drawn once, when the rows are laid out: one job reads the key columns, keeps a sample drawn by
hash, ranks it per key and brings back a cut for every ``slice_rows`` rows or so. The cuts are then constants of
the plan and the slice is a column, so any evaluation finds the same slices, nothing is written, and the rows are shuffled
once, by the window. A key of fewer rows is not cut; without any cut a scan is a plain window.
Where there are cuts, they and the contributions are tables of about one entry per ``slice_rows`` rows, and are broadcast.

``order`` must be unique within a key; that is also what lets a burst of equal
timestamps be cut. Rows are read again for the sample, and those of cut keys for the contributions: write the result of
a costly plan before it is laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Number of the slice; -1 in keys that are not cut.
SLICE = "_slice"
#: Rows of a key that make about one slice.
SLICE_ROWS = 1 << 20
#: Sampled rows between two cuts, where slices are long enough.
SAMPLED = 256
#: Cuts are looked up in two steps: among every ``STEP``-th, then among those that follow it. A key has STEP ** 2 at most.
STEP = 32
_ALL = "_all_rows"


@dataclass(frozen=True)
class Windows:
    """The windows a scan may use: ascending, descending and unordered."""

    up: Window
    down: Window
    whole: Window


@dataclass(frozen=True)
class Scan:
    """One prefix, suffix or group computation over ordered rows.

    inner: value inside the slice.
    part:  aggregate of one whole slice; gets the order struct.
    carry: combination of the other slices of the key, as a window over parts.
    join:  inner value and carry (null when the key has one slice) combined.
    """

    inner: Callable[[Windows], Column]
    part: Callable[[Column], Column]
    carry: Callable[[Column, Windows], Column]
    join: Callable[[Column, Column], Column]


def _before(window, exclusive: bool):
    return window.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def _add(inner: Column, carry: Column) -> Column:
    return inner + F.coalesce(carry, F.lit(0))


def ordinal() -> Scan:
    """0-based position inside the key."""
    return Scan(
        inner=lambda w: (F.row_number().over(w.up) - 1).cast("long"),
        part=lambda order: F.count(F.lit(1)),
        carry=lambda p, w: F.sum(p).over(_before(w.up, True)),
        join=_add,
    )


def group_size() -> Scan:
    """Number of rows of the key, on every row."""
    return Scan(
        inner=lambda w: F.count(F.lit(1)).over(w.whole),
        part=lambda order: F.count(F.lit(1)),
        carry=lambda p, w: F.sum(p).over(w.whole) - p,
        join=_add,
    )


def running_sum(value: Column, exclusive: bool = False) -> Scan:
    """Sum of ``value`` over the rows up to this one (0 where there are none)."""
    return Scan(
        inner=lambda w: F.coalesce(F.sum(value).over(_before(w.up, exclusive)), F.lit(0)),
        part=lambda order: F.sum(value),
        carry=lambda p, w: F.sum(p).over(_before(w.up, True)),
        join=_add,
    )


def running_max(value: Column, exclusive: bool = False) -> Scan:
    """Largest ``value`` among the rows up to this one, nulls ignored."""
    return Scan(
        inner=lambda w: F.max(value).over(_before(w.up, exclusive)),
        part=lambda order: F.max(value),
        carry=lambda p, w: F.max(p).over(_before(w.up, True)),
        join=lambda inner, carry: F.greatest(inner, carry),
    )


def last_value(value: Column, exclusive: bool = False) -> Scan:
    """Latest non-null ``value`` at or before this row."""
    return Scan(
        inner=lambda w: F.last(value, ignorenulls=True).over(_before(w.up, exclusive)),
        part=lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(_before(w.up, True)),
        join=lambda inner, carry: F.coalesce(inner, carry),
    )


def next_value(value: Column, exclusive: bool = False) -> Scan:
    """Earliest non-null ``value`` at or after this row."""
    return Scan(
        inner=lambda w: F.last(value, ignorenulls=True).over(_before(w.down, exclusive)),
        part=lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(_before(w.down, True)),
        join=lambda inner, carry: F.coalesce(inner, carry),
    )


def lag(value: Column) -> Scan:
    """``value`` of the row before, null values kept."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        inner=lambda w: F.lag(boxed).over(w.up),
        part=lambda order: F.max_by(boxed, order),
        carry=lambda p, w: F.lag(p).over(w.up),
        join=lambda inner, carry: F.coalesce(inner, carry)["v"],
    )


def lead(value: Column) -> Scan:
    """``value`` of the row after, null values kept."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        inner=lambda w: F.lead(boxed).over(w.up),
        part=lambda order: F.min_by(boxed, order),
        carry=lambda p, w: F.lead(p).over(w.up),
        join=lambda inner, carry: F.coalesce(inner, carry)["v"],
    )


class Laid:
    """Rows with their slice of ``(by, order)``; made by :func:`lay_out`."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], cut: int):
        """``cut``: most cuts of any key; its slices are numbered from 0 to that."""
        self.df, self.by, self.order, self.cut = df, list(by), list(order), cut

    def then(self, change: Callable[[DataFrame], DataFrame]) -> Laid:
        """Add columns or filter rows; the layout stays valid."""
        return Laid(change(self.df), self.by, self.order, self.cut)

    def rows(self) -> DataFrame:
        """The rows without the layout columns."""
        return self.df.drop(SLICE, _ALL)

    def scan(self, **scans: Scan) -> Laid:
        """Add one column per scan."""
        group = Window.partitionBy(*self.by, *([SLICE] if self.cut else []))
        inside = Windows(
            group.orderBy(*self.order), group.orderBy(*[F.desc(c) for c in self.order]), group
        )
        df = self.df.withColumns({f"_in_{n}": s.inner(inside) for n, s in scans.items()})
        if self.cut:
            df = self._attach_carry(df, scans)
        else:
            df = df.withColumns(
                {f"_out_{n}": s.join(F.col(f"_in_{n}"), F.lit(None)) for n, s in scans.items()}
            )
        helper = [c for c in df.columns if c.startswith(("_in_", "_carry_"))]
        df = df.drop(*[n for n in scans if n in df.columns], *helper)
        return Laid(
            df.withColumnsRenamed({f"_out_{n}": n for n in scans}), self.by, self.order, self.cut,
        )

    def _attach_carry(self, df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        order = F.struct(*self.order)
        parts = self.df.filter(F.col(SLICE) >= 0).groupBy(*self.by, SLICE).agg(
            *[s.part(order).alias(f"_part_{n}") for n, s in scans.items()]
        )
        key = Window.partitionBy(*self.by)
        across = Windows(key.orderBy(SLICE), key.orderBy(F.desc(SLICE)), key)
        names = [*self.by, SLICE]
        carry = (
            parts.select(
                *[F.col(c).alias(f"_carry_key{i}") for i, c in enumerate(names)],
                *[s.carry(F.col(f"_part_{n}"), across).alias(f"_carry_{n}") for n, s in scans.items()],
            )
        )
        match = [df[c].eqNullSafe(carry[f"_carry_key{i}"]) for i, c in enumerate(names)]
        # One row per slice of a cut key: about one per SLICE_ROWS rows.
        df = df.join(F.broadcast(carry), match, "left")
        return df.withColumns(
            {f"_out_{n}": s.join(F.col(f"_in_{n}"), F.col(f"_carry_{n}")) for n, s in scans.items()}
        )


def _cuts(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_rows: int) -> DataFrame:
    """Per key that is cut: its cuts in order, and every ``STEP``-th of them."""
    rate = max(1, slice_rows // SAMPLED)
    key = Window.partitionBy(*by)
    drawn = df.select(*by, *order)
    if rate > 1:
        drawn = drawn.filter(F.pmod(F.xxhash64(*by, *order), F.lit(rate)) == 0)
    drawn = drawn.select(
        *[F.col(c).alias(f"_cut_key{i}") for i, c in enumerate(by)], F.struct(*order).alias("_cut"),
        F.row_number().over(key.orderBy(*order)).alias("_place"), F.count(F.lit(1)).over(key).alias("_drawn"),
    )
    apart = F.greatest(F.lit(slice_rows // rate), F.ceil(F.col("_drawn") / STEP**2))
    marks = drawn.filter((F.col("_place") > 1) & ((F.col("_place") - 1) % apart == 0)).groupBy(*[f"_cut_key{i}" for i in range(len(by))])
    marks = marks.agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    return marks.withColumn("_firsts", F.transform(F.sequence(F.lit(0), F.size("_cuts") - 1, F.lit(STEP)), lambda i: F.get("_cuts", i)))


def lay_out(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_rows: int | None = None) -> Laid:
    """Give every row of ``df`` its slice: the number of cuts of its key at or before it. Runs one job, which draws the cuts."""
    if not by:
        df, by = df.withColumn(_ALL, F.lit(0)), [_ALL]
    marks = _cuts(df, by, order, slice_rows or SLICE_ROWS)
    # About one cut per SLICE_ROWS rows comes to the driver.
    drawn = marks.collect()
    if not drawn:
        return Laid(df.withColumn(SLICE, F.lit(-1)), by, order, cut=0)
    marks = df.sparkSession.createDataFrame(drawn, marks.schema)
    at = F.struct(*order)
    passed = lambda cuts: F.size(F.filter(cuts, lambda c: c <= at))
    block = passed(F.col("_firsts"))
    inside = passed(F.slice("_cuts", (block - 1) * STEP + 1, F.lit(STEP)))
    number = F.when(F.col("_cuts").isNull(), -1).when(block == 0, 0).otherwise((block - 1) * STEP + inside)
    joined = df.join(F.broadcast(marks), [df[c].eqNullSafe(marks[f"_cut_key{i}"]) for i, c in enumerate(by)], "left")
    return Laid(joined.select(*df.columns, number.alias(SLICE)), by, order, cut=max(len(m["_cuts"]) for m in drawn))
