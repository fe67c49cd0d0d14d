"""Greedy packing of ordered items into batches under a size budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.operators.ordered import SLICE, lay_out
from markwise.session import settle

_JUMPS = "_entry long, _reach double, _load double, _batches long"
_JUMP = [field.split()[0] for field in _JUMPS.split(", ")]


def _starts_after(prefix: np.ndarray, budget: float) -> np.ndarray:
    """For a batch starting at i, the first item that no longer fits."""
    nxt = np.searchsorted(prefix, prefix[:-1] + budget, side="right") - 1
    return np.maximum(nxt, np.arange(len(nxt)) + 1)


def _on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys come once."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    return left.join(named, [left[c].eqNullSafe(named[f"_r_{c}"]) for c in keys], how).drop(*[f"_r_{c}" for c in keys])


def _reachable(jumps: pd.DataFrame, budget: float) -> pd.DataFrame:
    """Jumps up to the first that even an empty batch takes: at most the items of one budget."""
    return jumps.iloc[: int(np.argmax(jumps["_reach"].to_numpy() > budget)) + 1]


def _composed(first: pd.DataFrame, then: pd.DataFrame, budget: float) -> pd.DataFrame:
    """The jumps over two neighbouring slices: those that open a batch in the first one, then those that pass through it."""
    passes = ~np.isfinite(first["_reach"].to_numpy())
    opens = first[~passes].copy()
    taken = np.searchsorted(then["_reach"].to_numpy(), budget - opens["_load"].to_numpy(), side="right")
    # The sum decides, as in the rule itself: one step back or on where the difference was rounded.
    reach, load = then["_reach"].to_numpy(), opens["_load"].to_numpy()
    taken = np.where((taken > 0) & (load + reach[taken - 1] > budget), taken - 1, taken)
    taken = np.where(load + reach[taken] > budget, taken, taken + 1)
    hit = then.iloc[taken]
    opens["_load"] = np.where(np.isfinite(hit["_reach"]), hit["_load"], load + hit["_load"])
    opens["_batches"] += hit["_batches"].to_numpy()
    if not passes.any():
        return _reachable(opens, budget)
    size = float(first["_load"].to_numpy()[passes][0])
    through = then.assign(_reach=then["_reach"] + size, _load=np.where(np.isfinite(then["_reach"]), then["_load"], then["_load"] + size))
    return _reachable(pd.concat([opens, through]), budget)


def pack_batches(
    df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: float,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ``batch_no``: a new batch opens when the next item would pass ``budget``.

    The rule is sequential, but where a slice of the ordered rows opens its
    first batch depends only on how full the running batch is on entry. Each
    slice of a key that is cut therefore reports, for each item that can open its first batch, the
    load it hands on and the batches it opens. Reports of neighbouring slices are composed in pairs, round by
    round, and the loads on entry come back down the same tree; a task sees two reports at a time, each of
    at most the items of one budget. Then the slices are packed in parallel. Keys that aren't cut are one slice.
    """
    order = list(order)
    laid = lay_out(df, by, order, slice_rows)
    by, rows, columns = laid.by, laid.df, list(df.columns)
    key_fields = [f for f in rows.schema.fields if f.name in (*by, SLICE)]
    keys_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields)
    key_names = [f.name for f in key_fields]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        prefix = np.concatenate([[0.0], np.cumsum(pdf[size].to_numpy(float))])
        m = len(pdf)
        nxt = _starts_after(prefix, budget)
        load, batches = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            j = nxt[i]
            load[i] = prefix[m] - prefix[i] if j >= m else load[j]
            batches[i] = 1 if j >= m else batches[j] + 1
        # items that can be the first not to fit: those within one budget of the slice start
        opens = np.flatnonzero((prefix[:-1] <= budget) & (np.diff(prefix) > 0))
        opens = np.unique(np.concatenate([[0], opens]))
        out = pd.DataFrame(
            {
                "_entry": np.append(opens, m),
                "_reach": np.append(prefix[opens + 1], np.inf),
                "_load": np.append(load[opens], prefix[m]),
                "_batches": np.append(batches[opens], 0),
            }
        )
        for c in key_names:
            out[c] = pdf[c].iloc[0]
        out = _reachable(out, budget)
        return out.assign(_nr=np.arange(len(out)))[[*key_names, "_nr", *_JUMP]]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The report of a node from those of its two halves (or of the left one alone)."""
        halves = [jumps.sort_values("_nr") for _, jumps in pdf.groupby("_half", sort=True)]
        out = halves[0] if len(halves) == 1 else _composed(*halves, budget)
        out = out.assign(_nr=np.arange(len(out)))
        return out[[*key_names, "_nr", *_JUMP]]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        prefix = np.concatenate([[0.0], np.cumsum(pdf[size].to_numpy(float))])
        nxt = _starts_after(prefix, budget)
        opened = np.zeros(len(pdf), dtype=np.int64)
        i = int(pdf["_entry"].iloc[0])
        while i < len(pdf):
            opened[i] = 1
            i = int(nxt[i])
        pdf["batch_no"] = pdf["_base"].iloc[0] + np.cumsum(opened) - 1
        return pdf[[*columns, "batch_no"]]

    def entered() -> DataFrame:
        """The entry item and first batch number of every slice of the keys that are cut."""
        node, reports = F.col(SLICE), f"{keys_ddl}, _nr long, {_JUMPS}"
        cut = rows.filter(node >= 0).select(*by, SLICE, *order, size)
        levels = [settle(cut.groupBy(*by, SLICE).applyInPandas(report, reports))]
        for _ in range(laid.cut.bit_length()):
            halves = levels[-1].withColumn("_half", node % 2).withColumn(SLICE, F.shiftright(node, 1))
            levels.append(settle(halves.groupBy(*by, SLICE).applyInPandas(compose, reports)))
        # From the whole key down: what a node hands to its left half is what it gets itself.
        state = levels[-1].select(*by, SLICE).distinct()
        state = state.withColumn("_in", F.lit(None).cast("double")).withColumn("_base", F.lit(0).cast("long"))
        for below in reversed(levels[:-1]):
            # A left half gets what its parent gets; the right one, where there is one, what the left one hands on.
            left = state.withColumn(SLICE, F.shiftleft(node, 1))
            load = F.when(F.col("_took._reach") < float("inf"), F.col("_took._load")).otherwise(F.coalesce("_in", F.lit(0.0)) + F.col("_took._load"))
            right = taken(left, below).select(
                *by, (node + 1).alias(SLICE), load.alias("_in"), (F.col("_base") + F.col("_took._batches")).alias("_base")
            )
            state = settle(left.unionByName(right))
        return taken(state, levels[0]).select(*key_names, F.col("_took._entry").alias("_entry"), "_base")

    def taken(state: DataFrame, level: DataFrame) -> DataFrame:
        """The jump that each node takes with the load on entry: its first without any."""
        fits = F.col("_in").isNull() | (F.col("_in") + F.col("_reach") > budget)
        rows = _on_keys(state, level, key_names).filter(fits).groupBy(*key_names, "_in", "_base")
        return rows.agg(F.min(F.struct("_nr", *_JUMP)).alias("_took"))

    if laid.cut:
        # One row per slice of a cut key.
        rows = _on_keys(rows, F.broadcast(entered()), key_names, "left")
    else:
        rows = rows.withColumns({"_entry": F.lit(None).cast("long"), "_base": F.lit(None).cast("long")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_entry", "_base")})
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.groupBy(*by, SLICE).applyInPandas(pack, f"{out}, batch_no long")
