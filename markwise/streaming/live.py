"""Live scoreboards and log monitors over appended rows.

Each job writes what a micro-batch changed below ``batch_id=<n>`` and overwrites
that folder when the batch is replayed, so a restart never counts twice. On
the same rows the result equals the batch operator's; where rows may come late, up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from markwise.operators.logs import stage_transitions, transition_label
from markwise.operators.score import is_correct
from markwise.session import scratch_path


def _write_batches(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _start(df: DataFrame, mode: str, checkpoint: str, write, **trigger) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key from the batches written so far."""
    rows = spark.read.parquet(path)
    body = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*body), "batch_id").alias("_r")).select(*keys, "_r.*")


def scoreboard_stream(
    attempts: DataFrame, path: str, checkpoint: str, key: str = "conv_id", dims: Sequence[str] = ("category",),
    watermark: tuple[str, str] | None = None, **trigger,
) -> StreamingQuery:
    """Right and wrong attempts per question; the first row of a ``key`` counts.

    State holds one entry per key. A watermark (column, delay) bounds it to the
    keys of that time, and then only repeats within the delay are recognised.
    """
    if watermark:
        attempts = attempts.withWatermark(*watermark)
    once = attempts.dropDuplicatesWithinWatermark([key]) if watermark else attempts.dropDuplicates([key])
    ok = is_correct(F.col("prediction"), F.col("truth"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # each batch adds its own counts; the board is their sum
        batch.groupBy("question_no", *dims).agg(
            F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect")
        ).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(once, "append", checkpoint, write, **trigger)


def scoreboard(spark, path: str, dims: Sequence[str] = ("category",)) -> DataFrame:
    """Tallies of all batches so far, one row per question."""
    return spark.read.parquet(path).groupBy("question_no", *dims).agg(
        F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect")
    )


def window_stream(
    events: DataFrame, path: str, checkpoint: str, ts: str = "ts", keys: Sequence[str] = ("stage",),
    length: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes", **trigger,
) -> StreamingQuery:
    """Events per stage in tumbling or sliding windows; changed windows are rewritten."""
    counts = (
        events.withWatermark(ts, watermark)
        .groupBy(F.window(ts, length, slide), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *keys, "n")
    )
    return _start(counts, "update", checkpoint, _write_batches(path), **trigger)


def session_stream(
    events: DataFrame, path: str, checkpoint: str, ts: str = "ts", keys: Sequence[str] = ("run_id",),
    gap: str = "6 hours", watermark: str = "10 minutes", **trigger,
) -> StreamingQuery:
    """Bursts of activity per key, closed after a pause; open ones come when the watermark passes."""
    sessions = (
        events.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
            *keys, "n",
        )
    )
    return _start(sessions, "append", checkpoint, _write_batches(path), **trigger)


def transition_stream(
    events: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("t_ms",), **trigger,
) -> StreamingQuery:
    """Stage transitions as logs grow, without delay and in order of arrival.

    A batch is joined to the last event each run had before, and scanned as an
    ordered table, so a run that dominates a batch is still cut into ranges.
    Events that come out of order across batches are linked in arrival order, and the last event of every
    run is kept for good; see :func:`ordered_transition_stream`.
    """
    columns = [*by, *order, "stage", "action", "message"]
    seen_path = f"{path}/seen"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        last = F.max_by(F.struct(*[c for c in columns if c not in by]), F.struct(*order)).alias("_last")
        if batch_id > 0:
            before = spark.read.parquet(f"{seen_path}/batch_id={batch_id - 1}")
            both = before.withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
        else:
            both = rows.withColumn("_old", F.lit(False))
        moves = stage_transitions(both, by, order)
        if batch_id > 0:  # what the remembered events led to, not the events themselves
            moves = moves.join(before.select(*by, *order), [*by, *order], "left_anti")
        moves.write.mode("overwrite").parquet(f"{path}/moves/batch_id={batch_id}")
        both.groupBy(*by).agg(last).select(*by, "_last.*").write.mode("overwrite").parquet(
            f"{seen_path}/batch_id={batch_id}"
        )

    return _start(events, "append", checkpoint, write, **trigger)


class _InOrder(StatefulProcessor):
    """Holds the events of a share of the runs until no earlier one can come, then releases them in order.

    Events are (k0, ..., c0, c1, ..., stage, us): the run, what orders its events, and the rest. State of a share: the events above the
    watermark, and the last one released of each run. A timer fires when
    the watermark passes the earliest event held; a run that has been quiet for ``keep_us`` is forgotten.
    """

    def __init__(self, event: StructType, n_keys: int, n_order: int, keep_us: int):
        self.event, self.keep_us = event, keep_us
        self.keys, self.order = event.names[:n_keys], event.names[n_keys : n_keys + n_order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.event)
        self.last = handle.getListState("last", self.event)

    def _wake_at(self, micros: int, earlier: bool = False) -> None:
        at, timers = int(micros) // 1000 + 1, list(self.handle.listTimers())
        if earlier and timers and min(timers) <= at:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _frame(self, state) -> pd.DataFrame:
        return pd.DataFrame(list(state.get()), columns=self.event.names, dtype=object).astype({"us": "int64"})

    def _store(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            rows = rows[self.event.names].astype(object)
            state.put([tuple(row) for row in rows.where(rows.notna(), None).itertuples(index=False)])
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for part in rows:
            part = part[self.event.names].astype(object)
            earliest.append(part["us"].min())
            self.held.appendList([tuple(row) for row in part.where(part.notna(), None).itertuples(index=False)])
        if earliest:
            self._wake_at(min(earliest), earlier=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        held, last = self._frame(self.held), self._frame(self.last)
        ready = held["us"] <= final
        out, later = held[ready], held[~ready]
        if len(out):
            self._store(self.held, later)
            rows = pd.concat([last.assign(old=True), out.assign(old=False)], ignore_index=True)
            rows = rows.drop_duplicates([*self.keys, *self.order])
            rows["run"] = rows.groupby(self.keys, dropna=False, sort=False).ngroup()
            rows = rows.sort_values(["run", *self.order])
            same = rows["run"] == rows["run"].shift()
            came = rows["stage"].shift()
            near = same & (rows["us"] - rows["us"].shift(fill_value=0) <= self.keep_us)
            moved = ~rows["old"].astype(bool) & near & came.notna() & rows["stage"].notna() & (came != "") & (came != rows["stage"])
            last = rows[rows["run"] != rows["run"].shift(-1)]
            found = rows.assign(from_stage=came)[moved]
            if len(found):
                yield found[[*self.keys, "from_stage", *self.event.names[len(self.keys) : -1]]]
        last = last[final - last["us"] < self.keep_us]
        self._store(self.last, last)
        if len(later):
            self._wake_at(later["us"].min())
        elif len(last):
            self._wake_at(int(last["us"].min()) + self.keep_us)

    def close(self) -> None:
        pass


def ordered_transition_stream(
    events: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("run_id",), order: Sequence[str] = ("t_ms",),
    ts: str = "ts", watermark: str = "10 minutes", keep_hours: float = 24 * 7, shares: int = 1024, **trigger,
) -> StreamingQuery:
    """Stage transitions in order of time, however late or often the events come, once the watermark has passed them.

    ``order`` must agree with ``ts``. Events later than ``watermark`` are dropped, repeats (by ``order``) count once. State is what lies above
    the watermark and one event for each run that was active within ``keep_hours``; a run that goes on after a longer pause
    starts anew. Runs are dealt over ``shares`` by hash and a share's state is read and written as a whole, so that a run costs rows and
    not calls. ``shares`` must not change between restarts. On the rows below the watermark the result equals the batch operator's, save for such pauses.
    """
    spark = events.sparkSession
    stored = {**{f"c{i}": c for i, c in enumerate(order)}, "action": "action", "message": "message", "stage": "stage"}
    keys = {f"k{i}": c for i, c in enumerate(by)}
    # Plain names: the processor gets its rows as named tuples.
    rows = events.withWatermark(ts, watermark).select(
        *(F.col(c).alias(k) for k, c in {**keys, **stored}.items()), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"),
        F.pmod(F.xxhash64(*by), F.lit(shares)).alias("share"),
    )
    event = StructType([*(rows.schema[c] for c in (*keys, *stored)), StructField("us", LongType())])
    out = StructType([*event.fields[: len(keys)], StructField("from_stage", StringType()), *event.fields[len(keys) : -1]])
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        released = rows.groupBy("share").transformWithStateInPandas(
            _InOrder(event, len(by), len(order), int(keep_hours * 3_600_000_000)), out, "Append", "EventTime"
        )
        moves = released.select(
            *(F.col(k).alias(c) for k, c in keys.items()), *(F.col(f"c{i}").alias(c) for i, c in enumerate(order)), "from_stage",
            F.col("stage").alias("to_stage"), transition_label().alias("label"),
        )
        return _start(moves, "append", checkpoint, _write_batches(path), **trigger)  # the query keeps a copy of the settings
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def run_to_end(spark, start, name: str) -> str:
    """Start a job on new scratch folders, let it read all there is, and give its output path."""
    path = scratch_path(spark, name)
    query = start(path, scratch_path(spark, f"{name}-state"))
    query.awaitTermination()
    return path
