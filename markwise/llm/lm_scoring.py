"""Cross-entropy difference of a target and a background n-gram model.

Both are word bigram models over one vocabulary, every word of all documents;
both are smoothed alike with their own unigrams. A document's score is its mean
loss per word under the target model minus that under the background model: low
scores look like the target.

Counts cover every document (background) and every document of the target
labels, and every word and pair of words, whatever its count. They stay
distributed. Documents are laid out in blocks of ``block_bytes``. Each block
asks for the totals of its own distinct words and pairs, one request for each
range of key hashes. Ranges are summed one by one, and answers hold the totals
in the order of the request, so that no key is sent back. A key has one entry a
block at most, so no word or pair is a hot key, and blocks and ranges grow in
number with the corpus, not in size. Only six sums reach the driver.

Keys are 64-bit hashes of words and of pairs. Texts without words, null texts
included, have 0 words and scores 0. Repeated rows count and score as often as
they come; null doc_ids are never target. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.llm.arrays import FOLD, SOLID, chunks, mix, words
from markwise.llm.columns import settle

BLOCK_BYTES = 8 << 20
#: Ranges of key hashes at least; a larger corpus has one for each half block.
LEAST_RANGES = 16
_PAIR = np.uint64(0x9E3779B97F4A7C15)
REQUEST = "range bigint, block bigint, word_keys binary, words binary, pair_keys binary, pairs binary"
ANSWER = "range bigint, block bigint, words binary, pairs binary, sums array<bigint>"
SCORES = "n_words bigint, target_loss double, background_loss double, loss_difference double"


class Block(NamedTuple):
    row: np.ndarray  # the document of each token
    first: np.ndarray  # whether a token is its text's first
    word: np.ndarray  # place of each token's word in word_keys
    pair: np.ndarray  # place of each token's (previous, word) in pair_keys
    word_keys: np.ndarray  # sorted
    pair_keys: np.ndarray


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key there."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place.astype(np.int32)


def _block(texts: pa.Array) -> Block:
    row, key = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for c in chunks(texts):
        found = words(FOLD[c.data], c.bounds, SOLID)
        row.append((found.row + c.first).astype(np.int32))
        key.append(found.hash)
    row, key = np.concatenate(row), np.concatenate(key)
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    both = np.zeros(len(key), dtype=np.uint64)
    both[1:] = key[:-1]
    both[first] = 0  # the start of a text
    both *= _PAIR
    both += key
    word_keys, word = _places(key)
    del key
    pair_keys, pair = _places(mix(both))
    return Block(row, first, word, pair, word_keys, pair_keys)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: most are 0 and compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _columns(blobs: list[bytes], kind: type, n: int) -> np.ndarray:
    """(n, entries): the numbers of several blobs side by side."""
    return np.concatenate([np.zeros((n, 0), kind), *(_numbers(b, kind).reshape(n, -1) for b in blobs)], axis=1)


def blocks(flagged: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block of documents: (block, size, doc_id, target, text), the last three arrays."""
    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema.fields}

    def row(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        arrays = [pa.ListArray.from_arrays([0, len(table)], table.column(k).combine_chunks()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), *arrays], ["size", *table.column_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for c in chunks(batch.column(2), block_bytes):
                if held and size + len(c.data) > block_bytes:
                    yield row(held, size)
                    held, size = [], 0
                held.append(batch.slice(c.first, c.last - c.first))
                size += len(c.data)
        if held:
            yield row(held, size)

    fields = ", ".join(f"{c} array<{kinds[c]}>" for c in ("doc_id", "target", "text"))
    found = flagged.select("doc_id", "target", "text").mapInArrow(run, f"size bigint, {fields}")
    return settle(found.withColumn("block", F.monotonically_increasing_id()))


def requests(laid: DataFrame, n_ranges: int) -> DataFrame:
    """Each block's distinct words and pairs with their own counts, by ranges of keys.

    Words have four counts: occurrences and text ends, in all texts and in target
    texts; pairs have two. A word starts a pair as often as it comes and ends no text.
    """

    def ranges(keys: np.ndarray) -> np.ndarray:
        held = (keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        return np.searchsorted(held, np.arange(n_ranges + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                b, chosen = _block(one.column(2).flatten()), one.column(1).flatten().to_numpy(zero_copy_only=False)
                target, last = chosen[b.row], np.roll(b.first, -1)
                count = lambda of, keys: np.bincount(of, minlength=len(keys)).astype(np.uint32)
                n_words = np.stack([count(b.word[x], b.word_keys) for x in (slice(None), target, last, last & target)])
                n_pairs = np.stack([count(b.pair[x], b.pair_keys) for x in (slice(None), target)])
                at, at_pair = ranges(b.word_keys), ranges(b.pair_keys)
                out = []
                for k in range(n_ranges):
                    w, p = slice(at[k], at[k + 1]), slice(at_pair[k], at_pair[k + 1])
                    if w.start < w.stop or p.start < p.stop:
                        steps = [_planes(np.diff(keys, prepend=np.uint64(0))) for keys in (b.word_keys[w], b.pair_keys[p])]
                        out.append((k, steps[0], _planes(n_words[:, w]), steps[1], _planes(n_pairs[:, p])))
                if out:
                    k, *blobs = zip(*out, strict=True)
                    block = pa.array(one.column(0).to_pylist() * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), block, *(pa.array(x, pa.binary()) for x in blobs)],
                        [f.split()[0] for f in REQUEST.split(", ")],
                    )

    return laid.select("block", "target", "text").mapInArrow(run, REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """The totals over all blocks for each request, entry by entry, and a row of each range's sums.

    Sums are distinct words, and the four counts of words.
    """

    def totals(keys: list[bytes], counts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        each = [np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for k in keys]
        every, own = np.unique(np.concatenate(each), return_inverse=True)
        total = np.stack([
            np.bincount(own, weights=c, minlength=len(every)) for c in _columns(counts, np.uint32, n)
        ]).astype(np.int64)
        return total, own, np.cumsum([0, *map(len, each)]).tolist()

    def run(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_pylist() for c in table.column_names}
        word, own_word, at = totals(held["word_keys"], held["words"], 4)
        pair, own_pair, at_pair = totals(held["pair_keys"], held["pairs"], 2)
        rows = len(table)
        return pa.table({
            "range": pa.array([*held["range"], held["range"][0]], pa.int64()),
            "block": pa.array([*held["block"], None], pa.int64()),
            "words": pa.array([*(_planes(word[:, own_word[at[i] : at[i + 1]]]) for i in range(rows)), None], pa.binary()),
            "pairs": pa.array([*(_planes(pair[:, own_pair[at_pair[i] : at_pair[i + 1]]]) for i in range(rows)), None], pa.binary()),
            "sums": pa.array([*[None] * rows, [word.shape[1], *word.sum(axis=1).tolist()]], pa.list_(pa.int64())),
        })

    return settle(asked.groupBy("range").applyInArrow(run, ANSWER))


def _score(laid: DataFrame, answered: DataFrame, weight: float) -> DataFrame:
    sums = answered.filter("block IS NULL").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(5)]).first()
    distinct, n_all, n_target, texts, texts_target = map(int, sums)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, text = (left.column(c).combine_chunks().flatten() for c in ("doc_id", "text"))
        b, right = _block(text), right.sort_by("range")
        word = _columns(right.column("words").to_pylist(), np.int64, 4)
        pair = _columns(right.column("pairs").to_pylist(), np.int64, 2)
        before = np.roll(b.word, 1)
        n = np.bincount(b.row, minlength=len(doc))
        mean = []
        for k, total, starts in ((1, n_target, texts_target), (0, n_all, texts)):
            single = (word[k] + 1.0) / max(1, total + distinct)
            context = np.where(b.first, starts, (word[k] - word[k + 2])[before]) if len(b.word) else np.zeros(0)
            loss = -np.log((pair[k][b.pair] + weight * single[b.word]) / (context + weight))
            mean.append(np.bincount(b.row, weights=loss, minlength=len(doc)) / np.maximum(n, 1))
        values = [n, *(np.round(x, 6) for x in (*mean, mean[0] - mean[1]))]
        return pa.table([doc, *map(pa.array, values)], names=["doc_id", *(f.split()[0] for f in SCORES.split(", "))])

    kind = laid.schema["doc_id"].dataType.elementType.simpleString()
    known = answered.filter("block IS NOT NULL").select("block", "range", "words", "pairs")
    left = laid.select("block", "doc_id", "text").groupBy("block")
    return left.cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {SCORES}")


def score(docs: DataFrame, target: DataFrame, weight: float = 100.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words, mean loss under each model and their difference, of every document; ``target`` holds the target's doc_ids."""
    ids = target.select("doc_id").dropna().distinct().withColumn("target", F.lit(True))
    # One plan at every size: a broadcast of the ids would only serve small corpora.
    ids = ids.hint("merge")
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    laid = blocks(flagged.withColumn("target", F.coalesce("target", F.lit(False))), block_bytes)
    size = laid.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _score(laid, answers(requests(laid, max(LEAST_RANGES, -(-2 * size // block_bytes)))), weight)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores against the documents labelled as good (quality 1)."""
    return score(docs, labels.filter(F.col("quality") == 1).select("doc_id"), **options)
