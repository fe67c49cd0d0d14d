"""A hash tree over the rows of a dataset, whose parents keep the SHA-256 states between their children.

A parent hashes the hex digests of at most ``FAN`` = 16 children. A digest in hex is one 64-byte block, so the
state of SHA-256 before each child slot is a chaining value of 32 bytes, kept beside the
digest. When a child changes, folding takes up the state before its slot, adds
the replacement and the siblings to its right, and never reads those on its left.

Leaves are ranked inside their source over ranges of (source, doc_id), so a hot source
spans many tasks; each level is one shuffle of a sixteenth of the level below. Going down again,
every node gets the path to the root from its parent, which has at most 16
children: no join key is hot, and rows leave in bundles of one parent's leaves.

Null values hash as ``-``; null ids come first. Rows equal in id are ordered by their leaf, and repeated rows are
leaves of their own. A null doc_id is never tampered with. An empty table has no tree and no rows. Columns beyond the five hashed ones play no part,
whatever their names. Texts are hashed whole, in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.llm.columns import ranked, settle

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one pass of the vectorised compression works on.
TILE = 4096
STEP = "struct<slot:int,kids:string,states:binary>"


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
#: The published constants: fractions of square roots of the first 8 primes and of cube roots of the first 64.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], dtype=np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), dtype=np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block (n, 16) of big-endian words each."""
    out = np.empty_like(state)
    for first in range(0, len(state), TILE):
        w = [np.ascontiguousarray(x) for x in block[first : first + TILE].T]
        before = [np.ascontiguousarray(x) for x in state[first : first + TILE].T]
        a, b, c, d, e, f, g, h = before
        for t in range(64):
            if t >= 16:
                x, y = w[(t - 15) % 16], w[(t - 2) % 16]
                x = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
                y = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
                w[t % 16] = w[t % 16] + x + w[(t - 7) % 16] + y
            s = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t % 16]
            m = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = s + m, a, b, c, d + s, e, f, g
        for i, x in enumerate((a, b, c, d, e, f, g, h)):
            out[first : first + TILE, i] = x + before[i]
    return out


def _closing(n_kids: np.ndarray) -> np.ndarray:
    """The padding block after ``n_kids`` whole blocks."""
    block = np.zeros((len(n_kids), 16), dtype=np.uint32)
    block[:, 0] = 0x80000000
    block[:, 15] = n_kids * 512
    return block


def _hex(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as rows of 64 hex characters."""
    return _HEX[digest.astype(">u4").view(np.uint8).reshape(-1, 32)].reshape(-1, 64)


def _blocks(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-byte blocks of a string column as words, and where each row's begin (one more entry closes the last)."""
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]].view(">u4").astype(np.uint32).reshape(-1, 16), (bounds - bounds[0]) // 64


def _seal(kids: pa.Array) -> pa.Array:
    """Digest of the joined child digests, and the SHA-256 state before each of them."""
    block, start = _blocks(kids)
    n = np.diff(start)
    state = np.repeat(START[None, :], len(n), axis=0)
    kept = np.zeros((len(block), 8), dtype=np.uint32)
    for slot in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > slot)
        kept[start[on] + slot] = state[on]
        state[on] = compress(state[on], block[start[on] + slot])
    digest = _hex(compress(state, _closing(n)))
    raw = kept.astype(">u4").tobytes()
    return pa.StructArray.from_arrays(
        [pa.array([bytes(x).decode() for x in digest], pa.string()),
         pa.array([raw[32 * a : 32 * b] for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())],
        ["digest", "states"],
    )


def seal(kids: str) -> Column:
    return F.arrow_udf(_seal, "struct<digest:string,states:binary>")(kids)


def _fold(steps: pa.StructArray, entry: np.ndarray, slot: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Digests in hex of the parents in rows ``entry`` of ``steps`` (kids, states) with the child in ``slot`` replaced."""
    block, start = _blocks(steps.field("kids"))
    states = np.frombuffer(b"".join(steps.field("states").to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8)
    at, end = start[entry] + slot, start[entry + 1]
    state = compress(states[at], np.ascontiguousarray(new).view(">u4").astype(np.uint32))
    for ahead in range(1, FAN):
        on = np.flatnonzero(at + ahead < end)
        if len(on):
            state[on] = compress(state[on], block[at[on] + ahead])
    return _hex(compress(state, _closing(end - start[entry])))


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the result from bundles (docs, path, subroot, root).

    A step of the path without a slot is the leaves' own parent: there each leaf has its own.
    """
    for batch in batches:
        docs, path = batch.column("docs"), batch.column("path")
        if not len(docs):
            continue
        one = docs.flatten()
        bundle = np.repeat(np.arange(len(docs)), docs.value_lengths().to_numpy())
        steps, first = path.flatten(), np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy())])
        depth = np.diff(first)[bundle]
        kids, above = steps.field("kids").to_pylist(), steps.field("slot").to_pylist()
        slot = one.field("slot").to_numpy(zero_copy_only=False).astype(np.int64)

        apart = [k if s is None else k[: 64 * s] + k[64 * s + 64 :] for k, s in zip(kids, above, strict=True)]
        proof, last = [], -1
        for b, s in zip(bundle.tolist(), slot.tolist(), strict=True):
            if b != last:
                last, (begin, end) = b, first[b : b + 2]
                own = apart[begin] if begin < end and above[begin] is None else ""
                rest = "".join(apart[begin + bool(own) : end])
            proof.append(hashlib.sha256((own[: 64 * s] + own[64 * s + 64 :] + rest).encode()).hexdigest())

        fixed = np.array([-1 if s is None else s for s in above], dtype=np.int64)
        now = np.frombuffer("".join(one.field("bent").to_pylist()).encode(), np.uint8).reshape(-1, 64).copy()
        for level in range(int(depth.max(initial=0))):
            on = np.flatnonzero(depth > level)
            entry = first[bundle[on]] + level
            now[on] = _fold(steps, entry, np.where(fixed[entry] < 0, slot[on], fixed[entry]), now[on])
        folded = pa.array([bytes(x).decode() for x in now], pa.string())
        take = pa.array(bundle)
        yield pa.RecordBatch.from_arrays(
            [one.field("doc_id"), one.field("leaf"), batch.column("subroot").take(take), batch.column("root").take(take),
             pa.array(proof, pa.string()), folded],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
        )


def _leaf(*values: Column) -> Column:
    field = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source; null is the empty string), doc_id, leaf, and bent: the leaf after tampering."""
    own = [F.col(c) for c in FIELDS]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    bent = _leaf(*own[:-1], F.translate("text", capitals, capitals.lower()))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        _leaf(*own).alias("leaf"), F.when(chosen, bent).alias("bent"),
    ).withColumn("bent", F.coalesce("bent", "leaf"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (tree, idx, n, digest) of the trees with several; kept with kids and states."""
    kid = F.struct("idx", "digest")
    rows = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "n").agg(F.sort_array(F.collect_list(kid)).alias("k"))
    rows = rows.withColumn("kids", F.array_join("k.digest", "")).withColumn("sealed", seal("kids"))
    return settle(rows.select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "sealed.digest", "kids", "sealed.states"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Levels from ``nodes`` up, until every tree has one node."""
    levels = [nodes]
    while not levels[-1].filter("n > 1").isEmpty():
        levels.append(_parents(levels[-1]))
    return levels


def _with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with each node's path: one step a level up to the root, from ``tops`` (tree, path, subroot, root) down."""
    above = None
    for level in reversed(levels):
        single = level.filter("n = 1").join(tops, "tree")
        if above is None:
            above = single
            continue
        step = F.struct(F.expr(f"CAST(idx % {FAN} AS INT)").alias("slot"), "up_kids", "up_states").cast(STEP)
        parent = above.select(
            "tree", F.col("idx").alias("up"), F.col("kids").alias("up_kids"), F.col("states").alias("up_states"),
            F.col("path").alias("up_path"), "subroot", "root",
        )
        below = level.filter("n > 1").withColumn("up", F.expr(f"idx div {FAN}")).join(parent, ["tree", "up"])
        below = below.withColumn("path", F.concat(F.array(step), "up_path"))
        above = single.unionByName(below.select(*single.columns))
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, for every row of ``docs``."""
    placed = ranked(leaves(docs), "tree", ["doc_id", "leaf"])
    doc = F.struct(F.expr(f"CAST(idx % {FAN} AS INT)").alias("slot"), "doc_id", "leaf", "bent")
    bundle = placed.groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "n").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    bundle = bundle.withColumn("kids", F.array_join("docs.leaf", "")).withColumn("sealed", seal("kids"))
    lone = F.col("n") == 1  # such a leaf is its own subroot
    bundle = settle(bundle.select(
        "tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
        F.when(lone, F.col("docs")[0]["leaf"]).otherwise(F.col("sealed.digest")).alias("digest"),
        "kids", F.when(~lone, F.col("sealed.states")).alias("states"), "docs",
    ))
    levels = _levels(bundle)

    subroots = levels[0].filter("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.filter("n = 1").select("tree", "digest"))
    ordered = ranked(subroots.withColumn("all", F.lit("")), "all", ["tree"])
    top = _levels(settle(ordered.select(
        F.col("all").alias("tree"), "idx", "n", "digest", F.col("digest").alias("kids"), F.lit(None).cast("binary").alias("states"),
        F.col("tree").alias("name"),
    )))
    root = top[-1].filter("n = 1").select(
        "tree", F.array().cast(f"array<{STEP}>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    top = [level if "name" in level.columns else level.withColumn("name", F.lit(None).cast("string")) for level in top]
    tops = _with_paths(top, root).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")

    levels = [level if "docs" in level.columns else level.withColumn("docs", F.lit(None).cast(bundle.schema["docs"].dataType)) for level in levels]
    whole = _with_paths(levels, settle(tops))
    own = F.struct(F.lit(None).cast("int").alias("slot"), "kids", "states").cast(STEP)
    path = F.when(F.col("states").isNotNull(), F.concat(F.array(own), "path")).otherwise(F.col("path"))
    rows = whole.select("docs", path.alias("path"), "subroot", "root")
    out = rows.mapInArrow(
        _unfold, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
