"""Language identification with string kernels.

The kernel of two texts is the number of distinct byte n-grams (one to three
bytes, hashed) that both hold, over the root of the product of their numbers: a
blended-spectrum presence kernel. Texts are compared with a fixed set of
landmark texts (Nystroem), and one-versus-rest kernel ridge regression on those
features gives a score per language. Batches of texts are scored by two matrix
products.

A text that is null or has no letter is ``und`` with score 0, as is every text
when nothing could be learned. Null languages and null doc_ids are never learned
from. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.llm.arrays import FOLD, Chunk, chunks
from markwise.llm.columns import per_text

GRAMS = 1 << 14
BLOCK = 128


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # n-grams x landmarks, each column scaled by 1 / root of its number of n-grams
    weights: np.ndarray  # landmarks x languages


def _presence(c: Chunk, first: int, last: int) -> np.ndarray:
    """A 0/1 row of hashed n-grams for each text; n-grams don't cross texts."""
    low, high = c.bounds[first], c.bounds[last]
    data = FOLD[c.data[low:high]].astype(np.uint32) + np.uint32(1)
    row = np.repeat(np.arange(last - first), np.diff(c.bounds[first : last + 1])).astype(np.int64)
    out = np.zeros((last - first) * GRAMS, dtype=np.float32)
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 4):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(18)
        inside = row[: len(code)] == row[n - 1 :]
        out[(row[: len(code)] * GRAMS + bucket)[inside]] = 1
    return out.reshape(last - first, GRAMS)


def _blocks(c: Chunk):
    for first in range(0, len(c.bounds) - 1, BLOCK):
        last = min(first + BLOCK, len(c.bounds) - 1)
        yield first, last, _presence(c, first, last)


def _kernel(presence: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
    return (presence @ landmarks) / size


def learnable(docs: DataFrame) -> DataFrame:
    """The documents the contract lets a model see."""
    return docs.select("doc_id", "text", "lang").dropna().filter(~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, per_language: int, max_rows: int, seed: int) -> DataFrame:
    """At most ``per_language`` documents of each language and ``max_rows`` in all, taken by hash of doc_id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = (
        docs.select("doc_id", "lang").withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= per_language).orderBy("_place", "lang").limit(max_rows).select("doc_id", "_place")
    )
    # At most max_rows rows of two numbers.
    return docs.join(F.broadcast(chosen), "doc_id").filter(has_letter(F.col("text")))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    docs: DataFrame, per_language: int = 500, landmarks_per_language: int = 32, max_rows: int = 20_000,
    ridge: float = 1e-3, seed: int = 8,
) -> KernelModel | None:
    """A model from at most ``per_language`` learnable documents of each language.

    The first ``landmarks_per_language`` of them by hash are the landmarks.
    What reaches the driver is landmark n-gram sets and kernel rows, not texts.
    """
    rows = _sample(learnable(docs), per_language, max_rows, seed).persist()
    try:

        def sets(batches):
            for batch in batches:
                for c in chunks(batch.column(0)):
                    for first, last, presence in _blocks(c):
                        grams = [np.flatnonzero(x).astype(np.int32) for x in presence]
                        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.int32()))], ["grams"])

        few = rows.filter(F.col("_place") <= landmarks_per_language)
        found = few.orderBy("lang", "_place").select("text").mapInArrow(sets, "grams array<int>").toArrow()
        landmarks = np.zeros((GRAMS, found.num_rows), dtype=np.float32)
        for i, grams in enumerate(found["grams"].to_pylist()):
            landmarks[grams, i] = 1 / np.sqrt(len(grams))
        if not found.num_rows:
            return None

        def kernel_rows(batches):
            for batch in batches:
                for c in chunks(batch.column(0)):
                    for first, last, presence in _blocks(c):
                        k = _kernel(presence, landmarks)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(k), pa.list_(pa.float32())),
                             batch.column(1)[c.first + first : c.first + last]], ["k", "lang"],
                        )

        table = rows.select("text", "lang").mapInArrow(kernel_rows, "k array<float>, lang string").toArrow()
    finally:
        rows.unpersist()
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    k = np.array(table["k"].to_pylist(), dtype=np.float64)
    targets = np.array([[name == x for x in languages] for name in names], dtype=np.float64)
    values, vectors = np.linalg.eigh(landmarks.T.astype(np.float64) @ landmarks)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: features k @ root have the kernel as inner product
    features = k @ root
    # Every language weighs the same, whatever its share of the sample.
    scale = 1 / targets.sum(axis=0)[targets.argmax(axis=1)][:, None]
    gram = features.T @ (features * scale) + ridge * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ (targets * scale))
    return KernelModel(languages, landmarks, weights.astype(np.float32))


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """Language and score (0 to 1) of every document."""
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by parameters: 2**14 x landmarks

    def compute(c: Chunk) -> list:
        m = shared.value
        names, scores = [], []
        for _, _, presence in _blocks(c):
            score = _kernel(presence, m.landmarks) @ m.weights
            best = score.argmax(axis=1)
            names += [m.languages[i] for i in best]
            scores.append(np.clip(score[np.arange(len(best)), best], 0, 1).astype(np.float64))
        return [names, np.round(np.concatenate(scores), 6)]

    found = per_text(compute, "lang_pred string, score double")(F.col("text"))
    known = has_letter(F.col("text"))
    rows = base.select("doc_id", "held_out", known.alias("known"), found.alias("found"))
    return rows.select(
        "doc_id", "held_out", F.when(F.col("known"), F.col("found.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("known"), F.col("found.score")).otherwise(0.0).alias("score"),
    )


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    return identify(docs, fit(docs, **options))
