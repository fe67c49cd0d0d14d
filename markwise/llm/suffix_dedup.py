"""Exact removal of repeated byte strings with a logarithmic family of suffix indexes.

Suffixes are sampled where a window of ``SPAN`` bytes has its least ``ANCHOR``-byte
hash (an anchor): equal windows pick the same place, so every window belongs to
one anchor, and only anchors with an equal hash can have equal windows. A
batch's suffix array is the list of its anchors sorted by that hash and then by
a hash of all text its windows cover (the context). A merge scan walks sorted
lists and looks at neighbours only:

* a neighbour with the same context: all windows of the anchor repeat;
* a neighbour with the same anchor hash but another context: the anchor's
  windows are compared one by one, again as a sorted list with neighbours.

Each new batch is scanned against every level of the index; two levels of equal
size merge into one of twice the size. Sorted lists are cut into ranges; the
first and last row of each range meet their neighbours in a small second step,
so a string that a third of all rows share is spread over many tasks.

A removed byte lies in a ``SPAN``-byte window that also starts elsewhere, in the
same or another text; all copies lose it. Equality is that of 112-bit (contexts)
and 80-bit (windows) hashes. Null and short texts lose nothing; repeated rows
lose all windows; rows with a null doc_id are known by their text. One doc_id
must not name two texts. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.llm.arrays import Chunk, RangeHash, chunks, mix
from markwise.llm.columns import settle
from markwise.session import scratch_path

SPAN = 200
ANCHOR = 100
LISTED = "anchor bigint, context bigint, id bigint, place bigint"
ORDER = ["anchor", "context", "id", "place"]


def text_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))


def anchors(c: Chunk, span: int = SPAN, anchor: int = ANCHOR):
    """For each anchor of a chunk: row, place in the row, first window's distance before it, number of windows - 1,
    hash, context hash."""
    n, choices = len(c.data), span - anchor + 1
    if n < span:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    hashed = RangeHash(c.data)
    at = np.arange(n - anchor + 1)
    low = np.uint64((1 << 32) - 1)
    gram = hashed(at, at + anchor)
    least = (gram & ~low) | at.astype(np.uint64)  # ties go to the first
    width = 1
    while width * 2 <= choices:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < choices:
        least = np.minimum(least[: len(least) - (choices - width)], least[choices - width :])
    row = np.searchsorted(c.bounds, np.arange(n - span + 1), "right") - 1
    window = np.flatnonzero(np.arange(n - span + 1) + span <= c.bounds[row + 1])
    if not len(window):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    row, own = row[window], (least[window] & low).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    own, row = own[first], row[first]
    before, more = own - window[first], window[last] - window[first]
    context = hashed(window[first], window[last] + span) ^ mix(before.astype(np.uint64))
    return row, own - c.bounds[row], before, more, gram[own], context


def suffixes(docs: DataFrame) -> DataFrame:
    """The sampled suffixes of ``docs`` (id, text); ``place`` holds place, distance before and windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                row, place, before, more, gram, context = anchors(c)
                packed = (place << 16) | (before << 8) | more
                columns = [(gram >> np.uint64(16)).view(np.int64), context.view(np.int64), ids[c.first : c.last][row], packed]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ORDER)

    return docs.select("id", "text").mapInArrow(run, LISTED)


def _judge(anchor, context) -> np.ndarray:
    """For sorted rows: 1 if a neighbour has the same context, plus 2 if one has the same anchor but another context."""
    same = anchor[1:] == anchor[:-1]
    equal = same & (context[1:] == context[:-1])
    other = same & ~equal
    state = np.zeros(len(anchor), dtype=np.int64)
    for flag, value in ((equal, 1), (other, 2)):
        state[1:] |= value * flag
        state[:-1] |= value * flag
    return state


def merge_scan(rows: DataFrame, keep: int) -> DataFrame:
    """(id, place, anchor, state) of the rows whose state has a bit of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 2 * TaskContext.get().partitionId()
        held, first = None, True  # the last two rows: one told already, one that waits for its neighbour

        def told(columns, state, start, stop, edge):
            edges = np.full(stop - start, -1, dtype=np.int64)
            if edge is not None:
                edges[0] = edge
            take = ((state[start:stop] & keep) > 0) | (edges >= 0)
            out = [*(x[start:stop][take] for x in columns), state[start:stop][take], edges[take]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], [*ORDER, "state", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy() for k in range(4)]
            columns = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            start, stop = (0 if held is None else len(held[0]) - 1), len(columns[0]) - 1
            if stop > start:
                yield told(columns, _judge(columns[0], columns[1]), start, stop, number if first else None)
                first = False
            held = [x[max(0, stop - 1) :] for x in columns]
        if held is not None:
            n = len(held[0])
            yield told(held, _judge(held[0], held[1]), n - 1, n, number if first else number + 1)

    ordered = rows.select(*ORDER).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    found = settle(ordered.mapInArrow(run, f"{LISTED}, state bigint, edge bigint"))
    # Two rows of each range.
    by = Window.orderBy("edge")
    bits = F.lit(0).cast("bigint")
    for side in (F.lag, F.lead):
        same = side("anchor").over(by) == F.col("anchor")
        equal = side("context").over(by) == F.col("context")
        bits = bits.bitwiseOR(F.when(same, F.when(equal, F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(0)).cast("bigint"))
    met = found.filter("edge >= 0").withColumn("state", F.col("state").bitwiseOR(bits))
    rows = found.filter("edge < 0").unionByName(met).select("id", "place", "anchor", "state")
    return rows.filter(F.col("state").bitwiseAND(F.lit(keep)) > 0)


class SuffixIndex:
    """Levels of sorted suffix lists; ``add`` takes a batch and returns what it shares with them or itself."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        rows = settle(suffixes(batch))
        found = None
        for _, level in self.levels or [(0, rows.limit(0))]:
            part = merge_scan(rows.unionByName(level), 3)
            found = part if found is None else found.unionByName(part)
        size = 1
        while self.levels and self.levels[-1][0] == size:
            size, rows = 2 * size, settle(self.levels.pop()[1].unionByName(rows).sortWithinPartitions(*ORDER))
        self.levels.append((size, rows))
        return found


def windows(docs: DataFrame, open_anchors: DataFrame) -> DataFrame:
    """Every window of the given anchors (id, place) as a list to scan: its hash is the context, its start the place."""
    wanted = open_anchors.groupBy("id").agg(F.collect_set("place").alias("places"))
    texts = docs.select("id", "text").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for c in chunks(batch.column(1)):
                part = lists.slice(c.first, c.last - c.first)
                packed = part.flatten().to_numpy()
                row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                at = (packed >> 16) + c.bounds[row]
                n = (packed & 0xFF) + 1
                each = np.repeat(np.arange(len(packed)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                start = (at - ((packed >> 8) & 0xFF))[each] + step
                hashed = RangeHash(c.data)
                fine = start + SPAN <= c.bounds[row[each] + 1]  # false only where one doc_id names two texts
                start, each = start[fine], each[fine]
                own = at[each]
                columns = [
                    (hashed(own, own + ANCHOR) & np.uint64(0xFFFF)).view(np.int64),
                    hashed(start, start + SPAN).view(np.int64), ids[c.first : c.last][row[each]],
                    start - c.bounds[row[each]],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ORDER)

    return texts.join(wanted, "id").select("id", "text", "places").mapInArrow(run, LISTED)


def in_batches(rows: DataFrame, n: int) -> Iterator[DataFrame]:
    """``rows`` (id, text) in ``n`` batches by hash of their id, written once so that each reads its own files only."""
    spark = rows.sparkSession
    path = scratch_path(spark, "batches")
    batch = F.pmod(F.xxhash64("id"), F.lit(n))
    # Each task holds a range of batches, so files are few.
    rows.withColumn("batch", batch).repartitionByRange("batch", "id").write.partitionBy("batch").parquet(path)
    # One file index for all: a batch is a filter on the folder's name.
    stored = spark.read.schema("id bigint, text string, batch bigint").parquet(path)
    for i in range(n):
        yield stored.filter(F.col("batch") == i).select("id", "text")


def repeated_spans(docs: DataFrame, batch_bytes: int = 16 << 30) -> DataFrame:
    """(id, first, last): starts of repeated windows, as runs of neighbouring starts.

    Texts enter the index in batches of about ``batch_bytes``, by hash of their id.
    """
    rows = docs.select(text_key().alias("id"), "text").filter(F.octet_length("text") >= SPAN)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // batch_bytes))
    index, found = SuffixIndex(), None
    batches = [rows] if n == 1 else in_batches(rows, n)
    for batch in batches:
        part = index.add(batch)
        found = part if found is None else found.unionByName(part)
    found = settle(found)
    place = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))
    whole = found.filter(F.col("state").bitwiseAND(F.lit(1)) > 0).select(
        "id", place.alias("first"), (place + F.col("place").bitwiseAND(F.lit(0xFF))).alias("last")
    )
    single = merge_scan(windows(rows, found.filter(F.col("state").bitwiseAND(F.lit(2)) > 0)), 1)
    return whole.unionByName(single.select("id", F.col("place").alias("first"), F.col("place").alias("last")))


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in parts:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for c in chunks(texts):
            part = spans.slice(c.first, c.last - c.first)
            row = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
            flat = part.flatten()
            change = np.zeros(len(c.data) + 1, dtype=np.int64)
            if len(flat):
                first, last = (flat.field(k).to_numpy() + c.bounds[row] for k in (0, 1))
                end = np.minimum(last + SPAN, c.bounds[row + 1])
                np.add.at(change, np.minimum(first, end), 1)
                np.add.at(change, end, -1)
            gone = np.cumsum(change)[:-1] > 0
            for a, b in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
                own = gone[a:b]
                n = int(own.sum())
                n_bytes.append(b - a)
                n_removed.append(n)
                n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0)
                kept.append(c.data[a:b][~own].tobytes() if n else c.data[a:b].tobytes())
        yield pa.StructArray.from_arrays(
            [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with a struct column ``cut``: n_bytes, n_removed, n_spans and the kept bytes.

    All other columns stay, whatever their names; one that is called ``cut`` is replaced.
    """
    spans = repeated_spans(docs, **options).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    whole = docs.select(text_key().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "cut"]).alias("row"))
    joined = whole.join(spans, "id", "left")
    return joined.select("row.*", F.arrow_udf(_cut, CUT)("row.text", "spans").alias("cut"))
