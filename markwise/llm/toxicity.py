"""Toxicity grades by cumulative-link ordinal regression on sparse words.

The features are a text's distinct words and word beginnings of four to six bytes. One weight per
feature is shared by all thresholds: P(grade >= k) is the logistic of (sum of
the weights of the text's features - threshold k), with ordered
thresholds. The expected severity is the sum of these over k.

The labels only say toxic or not. A toxic training text gets grade 1 to
``grades`` by how much log-odds evidence its words carry, in equal parts, so
the grades order texts by severity; all other labelled texts are grade 0.

Null and empty texts have severity 0 and are not toxic. Labels of unknown
documents, null labels and repeated labels (any toxic one counts) are allowed;
without a toxic or without a clean label every severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.llm.arrays import FOLD, LETTERED, Chunk, RangeHash, chunks, row_starts, words
from markwise.llm.columns import bounded_sample, per_text


BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning."""
    data = FOLD[c.data]
    found = words(data, c.bounds, LETTERED)
    hashed = RangeHash(data)
    rows, hashes = [found.row], [found.hash]
    for n in BEGINNINGS:
        long = found.end - found.start > n
        start = found.start[long]
        rows.append(found.row[long])
        hashes.append(hashed(start, start + n))
    return np.concatenate(rows), np.concatenate(hashes)


def _distinct_words(c: Chunk, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index in ``vocabulary``) pairs."""
    row, word = _features(c)
    at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    hit = vocabulary[at] == word
    pairs = np.unique(row[hit] * len(vocabulary) + at[hit])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _word_table(sample: DataFrame) -> DataFrame:
    """Distinct words of each sampled text: (word, toxic)."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(0)):
                row, word = _features(c)
                order = np.lexsort((word, row))
                row, word = row[order], word[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                row, word = row[new], word[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(toxic[c.first : c.last][row])],
                    ["word", "toxic"],
                )

    return sample.select("text", "toxic").mapInArrow(run, "word bigint, toxic int")


def _design(sample: DataFrame, vocabulary: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sampled texts as lists of word indexes, and their labels; at most ``max_rows`` rows reach the driver."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0)):
                row, at = _distinct_words(c, vocabulary)
                starts = row_starts(row, len(c.bounds) - 1)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1)[c.first : c.last]], ["at", "toxic"])

    table = sample.select("text", "toxic").mapInArrow(run, "at array<int>, toxic int").toArrow()
    return [np.array(x, np.int64) for x in table["at"].to_pylist()], table["toxic"].to_numpy()


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_words: int = 4096, least_evidence: float = 25.0,
    grades: int = 3, seed: int = 5,
) -> OrdinalModel:
    """A model from at most ``max_rows`` labelled documents, taken by hash, and the ``n_words`` most telling words.

    A word is telling by (toxic texts - expected) ** 2 / expected. Words below
    ``least_evidence`` are left out: among some ten thousand words, chance alone rarely reaches it.
    """
    named = (
        labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    # At most max_rows rows of two numbers: small enough to send to every task.
    chosen = F.broadcast(bounded_sample(named, max_rows, seed))
    sample = docs.select("doc_id", "text").dropna().join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")
    sample = sample.persist()
    try:
        n = {int(r.toxic > 0): r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(n) < 2:
            return OrdinalModel(np.zeros(1, np.uint64), np.zeros(1), np.full(grades, np.inf))
        counts = _word_table(sample).groupBy("word").agg(
            F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n")
        )
        expected = F.col("n") * (n[1] / (n[0] + n[1]))
        telling = (F.col("bad") - expected) * (F.col("bad") - expected) / expected
        rows = counts.filter("n >= 3").filter(telling >= least_evidence).orderBy(telling.desc(), "word").limit(n_words).collect()
        if not rows:
            return OrdinalModel(np.zeros(1, np.uint64), np.zeros(1), np.full(grades, np.inf))
        rows.sort(key=lambda r: r.word & (2**64 - 1))
        vocabulary = np.array([r.word for r in rows], np.int64).view(np.uint64)
        bad, total = np.array([r.bad for r in rows]), np.array([r.n for r in rows])
        texts, toxic = _design(sample, vocabulary)
    finally:
        sample.unpersist()
    odds = np.log((bad + 0.5) / (n[1] + 1)) - np.log((total - bad + 0.5) / (n[0] + 1))
    evidence = np.array([np.clip(odds[x], 0, None).sum() for x in texts])
    cuts = np.quantile(evidence[toxic > 0], np.arange(1, grades) / grades)
    grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, evidence, "right"), 0)
    return _fit_ordinal(vocabulary, texts, grade, grades)


def _fit_ordinal(vocabulary, texts, grade, grades: int, steps: int = 500, ridge: float = 2e-5) -> OrdinalModel:
    """Maximum likelihood of P(grade = k) = F(t[k+1] - s) - F(t[k] - s), by Adam on all rows."""
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    at = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
    w, n = np.zeros(len(vocabulary)), len(texts)
    raw = np.concatenate([[2.0], np.zeros(grades - 1)])  # first threshold, then logs of the gaps
    params = [w, raw]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        cuts = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]), [np.inf]])
        s = np.bincount(row, weights=w[at], minlength=n)
        upper, lower = logistic(cuts[grade + 1] - s), logistic(cuts[grade] - s)
        p = np.maximum(upper - lower, 1e-12)
        slope = (1 - upper - lower) / n
        d_cut = np.zeros(grades + 2)
        np.add.at(d_cut, grade + 1, -upper * (1 - upper) / p / n)
        np.add.at(d_cut, grade, lower * (1 - lower) / p / n)
        d_cut = d_cut[1:-1]
        d_raw = np.array([d_cut.sum(), *(d_cut[i:].sum() * np.exp(raw[i]) for i in range(1, grades))])
        grads = [np.bincount(at, weights=slope[row], minlength=len(w)) + ridge * w, d_raw]
        for value, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return OrdinalModel(vocabulary, w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def grade(model: OrdinalModel, text: Column, at_least: float = 0.5) -> Column:
    """A struct of ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)) and ``toxic`` (that reaches ``at_least``)."""

    def compute(c: Chunk) -> list:
        row, at = _distinct_words(c, model.words)
        s = np.bincount(row, weights=model.weights[at], minlength=len(c.bounds) - 1)
        p = 1 / (1 + np.exp(np.clip(model.thresholds[:, None] - s[None, :], -40, 40)))
        p[:, np.diff(row_starts(row, len(s))) == 0] = 0.0  # no known word, no evidence
        return [np.round(p.sum(axis=0), 6), np.round(p[0], 6), p[0] >= at_least]

    return per_text(compute, "severity double, p_toxic double, toxic boolean")(text)


def grade_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Severity of every document."""
    model = fit(docs, labels, **options)
    return docs.select("doc_id", grade(model, F.col("text")).alias("found")).select("doc_id", "found.*")
