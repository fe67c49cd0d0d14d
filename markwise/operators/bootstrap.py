"""Cluster bootstrap: whole videos are drawn with replacement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from markwise.operators.sampling import with_position

BLOCKS = 16  # parts into which the iterations of a run are cut
CHUNK = 1 << 16  # clusters whose totals travel in one row
PRIME = 2_147_483_647  # 2**31 - 1; x -> x**5 is a permutation modulo it
ROUND_KEYS = (48_271, 69_621, 16_807)


def cluster_totals(
    df: DataFrame, cluster: str, cols: Sequence[str], by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Sums of the outcome columns and the row count per run and cluster."""
    return df.groupBy(*by, cluster).agg(
        *[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n")
    )


def draws(first: int, last: int, n_sample: int, seed: int) -> np.ndarray:
    """The mixed numbers of iterations ``first`` to ``last`` - 1; modulo a run's cluster count they are its clusters.

    A draw is a keyed mix of its number, so it needs no state, can be recomputed
    on any executor and is shared by all runs: three rounds of
    ``(key * x + seed) ** 5`` modulo a prime; the last two outputs make the number.
    """
    x = (np.arange(first * n_sample, last * n_sample, dtype=np.int64) + seed) % PRIME
    before = x
    for key in ROUND_KEYS:
        before, a = x, (x * key + seed) % PRIME
        b = a * a % PRIME
        x = a * (b * b % PRIME) % PRIME
    return before * PRIME + x


def bootstrap_trials(
    df: DataFrame, cluster: str, cols: Sequence[str], by: Sequence[str] = ("run_id",),
    n_sample: int = 50, iters: int = 100_000, seed: int = 42,
) -> DataFrame:
    """One row per run and iteration with the drawn ratio of every outcome column.

    With two outcome columns ``gap`` is the first minus the second. A run's totals travel as arrays of at
    most ``CHUNK`` clusters, once for each of ``BLOCKS`` blocks of iterations; a block's draws are mixed once per task
    and looked up in the totals of all its runs. What several chunks of a run add to an iteration is summed.
    """
    totals = cluster_totals(df, cluster, cols, by)
    placed = with_position(totals, by, [cluster], "cluster_idx", "n_clusters").drop(cluster)
    sums = [*cols, "n"]
    part = F.sort_array(F.collect_list(F.struct("cluster_idx", *sums)))
    chunks = placed.groupBy(*by, "n_clusters", F.expr(f"cluster_idx div {CHUNK}").alias("chunk")).agg(part.alias("part"))
    chunks = chunks.select(*by, "n_clusters", "chunk", *(F.col(f"part.{c}").alias(c) for c in sums))
    blocks = min(BLOCKS, iters)
    spread = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.repartition("block", *by, "chunk").sortWithinPartitions("block")
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    out = StructType([*(StructField(c, kinds[c]) for c in by), StructField("iter", LongType()), *(StructField(c, kinds[c]) for c in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, of = None, -1
        for batch in batches:
            for row in range(len(batch)):
                at = {name: batch.column(name)[row] for name in ("n_clusters", "chunk", "block")}
                n_clusters, chunk, block = (x.as_py() for x in at.values())
                first, last = block * iters // blocks, (block + 1) * iters // blocks
                if block != of:
                    mixed, of = draws(first, last, n_sample, seed), block
                index = mixed % n_clusters - chunk * CHUNK
                own = np.clip(index, 0, CHUNK - 1)
                missed = None if n_clusters <= CHUNK else index != own
                found = []
                for name in sums:
                    values = batch.column(name)[row].values.to_numpy(zero_copy_only=False)
                    drawn = values[np.minimum(own, len(values) - 1)]
                    if missed is not None:
                        drawn[missed | (own >= len(values))] = 0
                    found.append(pa.array(drawn.reshape(-1, n_sample).sum(axis=1)))
                keys = [batch.column(c).slice(row, 1).take(pa.array(np.zeros(last - first, np.int64))) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(first, last)), *found], out.names)

    trials = spread.mapInArrow(run, out).groupBy(*by, "iter").agg(*[F.sum(c).alias(c) for c in sums])
    trials = trials.select(*by, F.col("iter").cast("int").alias("iter"), *[(F.col(c) / F.col("n")).alias(c) for c in cols])
    if len(cols) == 2:
        trials = trials.withColumn("gap", F.col(cols[0]) - F.col(cols[1]))
    return trials


def confidence_interval(
    trials: DataFrame, cols: Sequence[str], by: Sequence[str] = ("run_id",), lo: float = 0.025,
    hi: float = 0.975,
) -> DataFrame:
    """Percent interval and mean per run; a run has ``iters`` rows, which bounds the buffers."""
    aggs = []
    for c in cols:
        aggs += [
            (F.percentile(c, F.lit(lo)) * 100).alias(f"{c}_low"),
            (F.avg(c) * 100).alias(f"{c}_mean"),
            (F.percentile(c, F.lit(hi)) * 100).alias(f"{c}_high"),
        ]
    return trials.groupBy(*by).agg(*aggs)
