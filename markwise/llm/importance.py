"""Quality selection by importance resampling.

Hashed word n-gram models (one and two words, Laplace-smoothed) of the target
texts and of all raw texts give each document a log weight, the log of the
ratio of the two likelihoods. The documents with the largest log weight plus
Gumbel noise are a sample without replacement in proportion to the weights.

The noise is a hash of doc_id and a seed. Null and empty texts weigh 0 (log);
a null doc_id draws one fixed noise value; rows that tie with the last chosen
key are chosen too; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.llm.arrays import FOLD, SOLID, Chunk, chunks, mix, words
from markwise.llm.columns import bounded_sample, corpus_counts, per_text, settle

BUCKETS = 1 << 14


def _ngrams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words."""
    found = words(FOLD[c.data], c.bounds, SOLID)
    pair = found.row[1:] == found.row[:-1] if len(found.row) else np.zeros(0, bool)
    two = mix(found.hash[:-1] * np.uint64(3) + found.hash[1:])[pair] if len(found.row) else found.hash
    row = np.concatenate([found.row, found.row[1:][pair]]) if len(found.row) else found.row
    return row, (np.concatenate([found.hash, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batch: pa.RecordBatch, total: np.ndarray) -> None:
    for c in chunks(batch.column(0)):
        total += np.bincount(_ngrams(c)[1], minlength=BUCKETS)


def log_ratio(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 6) -> np.ndarray:
    """Log of target over raw probability of each bucket.

    Raw counts cover every document; the target model is fitted on at most
    ``max_rows`` documents of quality 1, taken by hash.
    """
    good = labels.filter(F.col("quality") == 1).select("doc_id").dropna().distinct()
    chosen = F.broadcast(bounded_sample(good, max_rows, seed))  # at most max_rows ids
    target = corpus_counts(docs.join(chosen, "doc_id", "left_semi").select("text"), _count, BUCKETS)
    raw = corpus_counts(docs.select("text"), _count, BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a whole-number column: four passes that count 16 bits each, nothing is sorted."""
    unsigned = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    digits = df.select(*[
        F.shiftrightunsigned(unsigned, 16 * i).bitwiseAND(F.lit(0xFFFF)).alias(f"d{i}") for i in (3, 2, 1, 0)
    ])
    value = 0
    for i in (3, 2, 1, 0):
        counts = digits.groupBy(f"d{i}").agg(F.count(F.lit(1)).alias("n")).collect()
        for digit, n in sorted(map(tuple, counts), reverse=True):
            if k <= n:
                break
            k -= n
        value = (value << 16) | digit
        digits = digits.filter(F.col(f"d{i}") == digit)
    return value - (1 << 63)


def resample(
    docs: DataFrame, labels: DataFrame, keep: float = 0.75, seed: int = 6, max_rows: int = 20_000
) -> DataFrame:
    """Log weight, noisy key and choice of every document; about ``keep`` of the rows are chosen."""
    ratio = log_ratio(docs, labels, max_rows, seed)

    def compute(c: Chunk) -> list:
        row, bucket = _ngrams(c)
        return [np.bincount(row, weights=ratio[bucket], minlength=len(c.bounds) - 1)]

    weight = per_text(compute, "log_weight double")(F.col("text"))
    uniform = ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53)))
    rows = settle(
        docs.select("doc_id", weight.alias("found")).select("doc_id", F.round("found.log_weight", 6).alias("log_weight"))
        .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
        .withColumn("_rank", F.round(F.col("gumbel_key") * F.lit(1e6)).cast("bigint"))
    )
    n = rows.count()
    if not n:
        return rows.drop("_rank").withColumn("selected", F.lit(False))
    cut = kth_largest(rows, "_rank", max(1, round(keep * n)))
    return rows.withColumn("selected", F.col("_rank") >= F.lit(cut)).drop("_rank")
