"""Nearest centroids by Orchard's search, and k-means rounds in whole numbers.

Every centroid has the list of the others, nearest first. A vector's search starts at
one centroid and walks down its list; a centroid that is closer (or as close, with a smaller number)
takes over and the walk goes on in its list. Centroids already measured are marked and not measured
again. The walk stops at a list entry strictly further from the current centroid than twice the current
distance: by the triangle inequality it, and all after it, are strictly further from the vector.

All vectors of an Arrow batch walk in step. A round sends one row per task and centroid
(count and 64 sums) to be added up; the driver holds the centroids and their k x k lists, whose size depends on k alone.

Vectors of another length, or with a null or a value that isn't finite, are left out. A null
id stays null (and is hashed as an empty string for the start). Repeated rows count as often as they occur; several
of one id may all start a centroid. With fewer vectors than ``k`` there are as many centroids. An empty table
gives no rows. Numbers are exact while |scale * x| is at most 2**27; a larger one is an error. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.llm.columns import settle

#: Largest absolute coordinate: 64 squared differences still fit in 63 bits.
LARGEST = 1 << 27


class Lists(NamedTuple):
    """Centroids (k, dims), for each the others by distance, and those squared distances."""

    at: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    #: Centroids sorted by their widest coordinate: where a search begins.
    axis: int
    by_axis: np.ndarray


def lists(at: np.ndarray) -> Lists:
    apart = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(apart)], dtype=np.int64).reshape(len(at), -1)
    axis = int(np.argmax(np.ptp(at, axis=0)))
    return Lists(at, order, np.take_along_axis(apart, order, axis=1), axis, np.argsort(at[:, axis], kind="stable"))


def search(vectors: np.ndarray, of: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid (ties: the smaller number), and how many distances were measured."""
    n, k = len(vectors), len(of.at)
    near = np.searchsorted(of.at[of.by_axis, of.axis], vectors[:, of.axis]).clip(0, k - 1)
    best = of.by_axis[near]
    distance = ((vectors - of.at[best]) ** 2).sum(axis=1)
    marked = np.zeros((n, k), dtype=bool)
    marked[np.arange(n), best] = True
    place, walking, measured = np.zeros(n, dtype=np.int64), np.arange(n), n
    while k > 1:
        walking = walking[place[walking] < k - 1]
        now = best[walking], place[walking]
        walking = walking[of.apart[now] <= 4 * distance[walking]]
        if not len(walking):
            break
        other = of.order[best[walking], place[walking]]
        place[walking] += 1
        new = ~marked[walking, other]
        rows, other = walking[new], other[new]
        marked[rows, other] = True
        measured += len(rows)
        d = ((vectors[rows] - of.at[other]) ** 2).sum(axis=1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (other < best[rows]))
        rows = rows[closer]
        best[rows], distance[rows], place[rows] = other[closer], d[closer], 0
    return best, distance, measured


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def grid(table: DataFrame, id_column: str, vector_column: str, dims: int, scale: int) -> DataFrame:
    """id and whole-number coordinates floor(scale * x) of the vectors of exactly ``dims`` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fits = batch.filter(pa.array(lengths == dims))
            x = fits.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[good])
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a coordinate is beyond {LARGEST} in absolute value: sums would not be exact")
            at = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(x.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([fits.column(0).filter(pa.array(good)), at], ["id", "at"])

    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("at"))
    return rows.mapInArrow(run, "id bigint, at array<int>")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(name.alias("name"), "at").orderBy("name", "at").limit(k).collect()
    return np.array([row.at for row in chosen], dtype=np.int64)


def moved(vectors: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors nearest to each."""
    of, dims = lists(at), at.shape[1]
    names = ["cluster", "n", *(f"s{i}" for i in range(dims))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), dims + 1), dtype=np.int64)
        for batch in batches:
            x = _vectors(batch.column(0))
            cluster = search(x, of)[0] if len(x) else np.zeros(0, np.int64)
            for c in np.unique(cluster):
                own = x[cluster == c]
                total[c, 0] += len(own)
                total[c, 1:] += own.sum(axis=0)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(dims + 1))], names)

    parts = vectors.select("at").mapInArrow(run, ", ".join(f"{name} bigint" for name in names))
    sums = parts.groupBy("cluster").agg(*(F.sum(name).alias(name) for name in names[1:])).collect()
    after = at.copy()
    for row in sums:
        after[row.cluster] = [s // row.n for s in row[2:]]
    return after


def cluster(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 16, rounds: int = 3,
    dims: int = 64, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """The id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    spark = table.sparkSession
    vectors = settle(grid(table, id_column, vector_column, dims, scale))
    at = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(at) else 0):
        at = moved(vectors, at)
    of = lists(at) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, distance, _ = search(_vectors(batch.column(1)), of)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    near = settle(vectors.mapInArrow(run, "id bigint, cluster int, distance bigint"))
    sums = dict(near.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = lambda x: hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()
    facts = [(c, total, sum(sums.values()), digest(at[c])) for c, total in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row a centroid: k at most.
    return near.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
