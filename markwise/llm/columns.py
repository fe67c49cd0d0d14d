"""Shared DataFrame pieces: per-text Arrow columns, corpus counts, bounded samples."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from markwise.llm.arrays import Chunk, chunks
from markwise.session import scratch_path

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def per_text(compute: Callable[[Chunk], list], ddl: str) -> Callable[[Column], Column]:
    """A struct column from a text column; ``compute`` gives one array per field for the rows of a chunk."""
    fields = [(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(ddl).fields]

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [compute(c) for c in chunks(texts)]
            columns = [
                pa.concat_arrays([pa.array(p[i], type=kind) for p in parts] or [pa.array([], kind)])
                for i, (_, kind) in enumerate(fields)
            ]
            yield pa.StructArray.from_arrays(columns, [name for name, _ in fields])

    return run


def corpus_counts(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """``count`` adds each Arrow batch of ``df`` into an array of ``size``; the sum over all tasks.

    Each task sends at most ``size`` rows, and ``size`` is a fixed parameter of the caller.
    """

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            count(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(size, dtype=np.int64)
    for bucket, n in df.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def small_batches(build: Callable) -> Callable:
    """``build(spark, ...)`` with Arrow batches of about 4 MB and 2,000 rows at most, so that a Python worker holds little text at once."""

    @functools.wraps(build)
    def run(spark, *args):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
        return build(spark, *args)

    return run


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; shuffle files of the write are removed when it ends."""
    spark = df.sparkSession
    path, before = scratch_path(spark, "rows"), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: broadcasts and shuffles of ended queries, on the executors too, stay until it does.

    A loop of many small queries fills the driver's heap with them, and a heap that has grown is not given back otherwise.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_sample(labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows`` rows of ``labels`` with the smallest hashes of their document: a fixed random sample."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(seed)), *labels.columns).limit(max_rows)


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with idx, its place from 0 among the rows of its ``key`` by ``order``, and n, the rows of the key.

    Rows are dealt by ranges of (key, order), so one key may span many tasks: each numbers
    its own part, and what earlier ranges hold of the key is added. Repeated rows are told apart by where
    they were read. The numbered rows are written once.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    laid = tie.repartitionByRange(key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie")
    names = laid.columns
    fields = [*laid.schema.fields, StructField("slice", IntegerType()), StructField("idx", LongType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(names.index(key))
            if not len(keys):
                continue
            new = np.concatenate([[keys[0].as_py() != last], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
            at = np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(new, at, -seen))
            idx = at - begin
            last, seen = keys[-1].as_py(), int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), own, np.int32)), pa.array(idx)], [*names, "slice", "idx"]
            )

    numbered = settle(laid.mapInArrow(number, StructType(fields)))
    parts = numbered.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("part"))
    whole = Window.partitionBy(key)
    parts = parts.select(
        key, "slice", F.sum("part").over(whole).alias("n"), (F.sum("part").over(whole.orderBy("slice")) - F.col("part")).alias("before")
    )
    return numbered.join(parts, [key, "slice"]).select(*names, (F.col("idx") + F.col("before")).alias("idx"), "n")
