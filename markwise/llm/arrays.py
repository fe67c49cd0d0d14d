"""Arrow batches of text as byte arrays: rows, words, and hashes of byte ranges, all vectorised.

Everything works on UTF-8 bytes. The word classes only name ASCII characters,
so a byte-wise scan equals a scan over code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and everything beyond ASCII.
LETTERED = np.zeros(256, dtype=bool)
LETTERED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Chunk(NamedTuple):
    """Rows ``first`` to ``last`` of a batch; row i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A column in pieces of about ``limit`` bytes; a longer text is a piece of its own. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield Chunk(first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * CHUNK_BYTES:  # the tables of an outsize text aren't kept
            kept = list(_powers)
            _powers[:] = []
            return kept
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any byte range of ``data`` from one running polynomial sum modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data))
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> Words:
    """The maximal runs of bytes of ``kind`` inside each row, with a hash of each."""
    inside = kind[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[bounds] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[bounds] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    return Words(start, end, row, RangeHash(data)(start, end))


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(RangeHash(data)(np.array([0]), np.array([len(data)]))[0])


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries start in arrays sorted by row; one more entry closes the last."""
    return np.searchsorted(row, np.arange(n_rows + 1))
