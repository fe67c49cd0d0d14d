"""Packs token pieces into fixed-length sequences: vector bin packing with the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Of the
pieces at hand that fit, the one whose demand has the largest dot product with
what is left (both as shares of the limits) goes in. When none fits, one piece
is cut to fill the rest, so only the last sequence of a task is padded.

Each task packs its own partition as a stream and holds a bounded pool of pieces
(less than one sequence each), so nothing is shuffled or gathered. A piece's ids
are hashed where they were made. Rows with null text have only the end token;
repeated rows are packed as often as they come; a null doc_id stays null; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.llm.arrays import SOLID, chunks, row_starts, words

FIELDS = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, loss_tokens bigint"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 4096
    loss: int = 4096


class WordTokens:
    """Token ids of texts; every word between ASCII white space is encoded once while it is remembered.

    The tokenizer never joins characters across white space, so the ids of a text are those of its words in order.
    """

    #: Words remembered before all are forgotten: some 35 MB.
    most_words = 1_000_000
    #: Words encoded in one call; each takes about a kilobyte until its ids are copied.
    at_once = 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.offset, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, new: np.ndarray) -> None:
        """Encodes the words at ``start`` to ``end``; ``new`` are their hashes, sorted and unknown."""
        known, lengths = [self.ids], []
        for i in range(0, len(new), self.at_once):
            spans = zip(start[i : i + self.at_once].tolist(), end[i : i + self.at_once].tolist(), strict=True)
            texts = [data[a:b].tobytes().decode() for a, b in spans]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, lists), np.int32, len(lists))
            lengths.append(n)
            known.append(np.fromiter((x for ids in lists for x in ids), np.uint32, int(n.sum())))
        n = np.concatenate(lengths)
        offset = len(self.ids) + np.cumsum(n) - n
        at = np.searchsorted(self.hash, new)
        self.hash = np.insert(self.hash, at, new)
        self.offset = np.insert(self.offset, at, offset)
        self.length = np.insert(self.length, at, n)
        self.ids = np.concatenate(known)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in order, and where each row's ids start."""
        found = words(data, bounds, SOLID)
        unique, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.hash) > self.most_words:
            self.forget()
        at = np.searchsorted(self.hash, unique)
        unknown = np.ones(len(unique), dtype=bool)
        inside = at < len(self.hash)
        unknown[inside] = self.hash[at[inside]] != unique[inside]
        if unknown.any():
            self.learn(data, found.start[first[unknown]], found.end[first[unknown]], unique[unknown])
            at = np.searchsorted(self.hash, unique)
        at = at[inverse]
        n = self.length[at]
        ends = np.cumsum(n, dtype=np.int64)
        take = np.repeat(self.offset[at] - (ends - n), n) + np.arange(int(n.sum()))
        rows = row_starts(found.row, len(bounds) - 1)
        return self.ids[take], np.concatenate([[0], ends])[rows]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that words stay known from task to task."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    prompt: int  # ids of the document before this position bear no loss

    def loss(self, n: int) -> int:
        return max(0, n - max(0, self.prompt - self.start))


class Packer:
    """Places a stream of pieces; ``pool`` bounds how many wait."""

    def __init__(self, limits: Limits, first_sequence: int, pool: int = 256):
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.limits, self.sequence, self.most = limits, first_sequence, pool
        self.pool: list[Piece] = []
        self.demand = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        self.pool.append(piece)
        if len(self.pool) >= self.most:
            self.close(len(self.pool) // 2)

    def close(self, keep: int = 0) -> None:
        """Fills sequences until at most ``keep`` pieces wait."""
        self.demand = np.array([[len(p.ids), 1, p.loss(len(p.ids))] for p in self.pool], dtype=float).reshape(-1, 3)
        while len(self.pool) > keep:
            self.fill()

    def fill(self) -> None:
        left, offset = self.caps.copy(), 0
        while len(self.pool):
            fits = np.flatnonzero((self.demand <= left).all(axis=1))
            if len(fits):
                worth = (self.demand[fits] / self.caps) @ (left / self.caps)
                at = fits[np.argmax(worth)]
                piece, n = self.pool[at], len(self.pool[at].ids)
            else:
                at, n = self.cut(left)
                if n <= 0:
                    break
                piece = self.pool[at]
            self.place(piece, n, offset)
            offset += n
            left -= [n, 1, piece.loss(n)]
            self.drop(at, n)
        self.sequence += 1

    def cut(self, left: np.ndarray) -> tuple[int, int]:
        """The piece that can give most ids to what is left, and how many."""
        if left[1] < 1 or left[0] < 1:
            return 0, 0
        free = np.array([max(0, p.prompt - p.start) for p in self.pool])
        give = np.minimum(np.minimum(self.demand[:, 0], left[0]), free + left[2]).astype(int)
        at = int(np.argmax(give))
        return at, int(give[at])

    def place(self, piece: Piece, n: int, offset: int) -> None:
        crc = zlib.crc32(piece.ids[:n].astype("<u4").tobytes())
        self.rows.append(
            (piece.doc_id, piece.start, n, crc, piece.doc_tokens, self.sequence, offset, piece.loss(n))
        )

    def drop(self, at: int, n: int) -> None:
        """Takes ``n`` ids off a waiting piece; a finished one makes room for the last."""
        piece = self.pool[at]
        if n < len(piece.ids):
            self.pool[at] = Piece(piece.doc_id, piece.start + n, piece.ids[n:], piece.doc_tokens, piece.prompt)
            self.demand[at] = [len(piece.ids) - n, 1, self.pool[at].loss(len(piece.ids) - n)]
            return
        last = self.pool.pop()
        if at < len(self.pool):
            self.pool[at] = last
            self.demand[at] = self.demand[len(self.pool)]
        self.demand = self.demand[: len(self.pool)]


def pack(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 2, prompt: str | None = None
) -> DataFrame:
    """One row per placed piece of each document's ids (then ``end_id``).

    ``prompt`` names a text column whose ids come first and bear no loss. A
    document longer than a sequence is cut into whole sequences first; its rest
    waits in the pool. Sequence numbers start at the task's number times 2**33.
    A limit of less than one token or segment is an error; a document whose
    loss exceeds the loss limit is cut there.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be at least 1")
    columns = ["doc_id", "text"] + ([prompt] if prompt else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)

        def flush():
            rows, packer.rows = packer.rows, []
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], NAMES)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            heads = [chunk for chunk in _rows(encode, batch.column(2))] if prompt else None
            for i, body in enumerate(_rows(encode, batch.column(1))):
                head = heads[i] if heads else body[:0]
                whole = np.concatenate([head, body, np.array([end_id], np.uint32)])
                for start in range(0, len(whole), limits.tokens):
                    part = whole[start : start + limits.tokens]
                    packer.add(Piece(ids[i], start, part, len(whole), len(head)))
                if len(packer.rows) > 20_000:
                    yield flush()
        packer.close()
        if packer.rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), *columns[1:]).mapInArrow(run, FIELDS)


def _rows(encode: WordTokens, texts: pa.Array) -> Iterator[np.ndarray]:
    for c in chunks(texts):
        ids, starts = encode(c.data, c.bounds)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield ids[a:b]
