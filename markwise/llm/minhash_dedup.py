"""MinHash near-duplicates by a chosen-path set similarity join.

A text's set is its distinct ``SHINGLE``-word shingles. Texts with equal sets are one
node of the graph. Every set is embedded as ``HASHES`` minhash values. A tree
sends a set to ``BRANCHES`` children, one per chosen minhash position, named by
the value there; two sets of similarity s share each child with probability s.
A tree node whose members can be compared exhaustively is a leaf; a larger one
branches again at positions chosen by its name. ``TREES`` independent trees make
the chance to miss a link of similarity 0.75 about (1/9) ** 6, or 2 in a million, at any depth.

Links inside one class needn't be found twice, so nodes first compare their members
with a few centres, and the links found give provisional classes. On every level
the leaves are compared, and the wider nodes' members outside a centre's class
with that centre. A node of one class is done, and a leaf compares members of different
classes only; a node is a leaf if all but ``LEAF`` of its members are of one class.
So a group of thousands of near copies costs a few stars, not all its pairs. All
links are confirmed on the full sets.

Null texts and texts without words have empty sets and link with nothing.
Repeated rows are in one class. Rows with a null doc_id have no class (null
component_id) and are kept. One doc_id must not name two texts.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markwise.llm.arrays import FOLD, SOLID, Chunk, chunks, mix, row_starts, words
from markwise.llm.columns import ARROW, let_go, settle

SHINGLE = 5
HASHES = 128
#: Minhash values of which two bits each are compared before a pair is confirmed; the first ``HASHES`` embed the set.
DIGESTED = 512
TREES = 6
BRANCHES = 2
#: Members outside the main class up to which a node is compared exhaustively: a branch sends near copies that are no links to several children each, level after level.
LEAF = 4096
#: Levels after which a node is compared exhaustively whatever its size.
DEEPEST = 40
#: Of the two-bit digests, those that may differ: similarity 0.75 has 96 on average, with deviation 8.8.
MOST_DIFFERENT = 134
#: Shingles from which on digests are compared: the minhash values of a smaller set err together, so its pairs are all confirmed.
LEAST_DIGESTED = 64

_draw = np.random.default_rng(1)
_XOR = _draw.integers(0, 2**32, DIGESTED, dtype=np.uint32)
_ODD = _draw.integers(0, 2**31, DIGESTED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
N_DIGESTS = DIGESTED // 32
DIGESTS = [f"d{i}" for i in range(N_DIGESTS)]
MEMBER = ["doc_id", "class", "n_shingles", "small", *DIGESTS]
#: Sets of at most so many shingles travel with their node rows: a set under LEAST_DIGESTED has similarity 0.75 with no larger one.
SMALL = LEAST_DIGESTED * 100 // 75
#: Members of a leaf's main class that one task compares with the other members.
BLOCK = 4096
#: Shingles of full sets that one block of a leaf holds, unless the members outside its main class have over a quarter of them.
BLOCK_SHINGLES = 1 << 21
#: Alike rows that a row is first compared with on full sets; four times as many follow each time.
FIRST_TESTED = 32
#: Words of 64 bits in the map of ids whose texts are read: its size doesn't depend on their number.
MAP_WORDS = 1 << 18
#: Centres drawn by hash, beside the least doc_id, that a first-level node's members are compared with at once.
TURNS = 2
SKETCH = ", ".join([
    *(f"{c} bigint" for c in ("doc_id", "n_shingles", "set_a", "set_b", *DIGESTS)), "nodes array<bigint>", "mins array<int>",
    "small array<bigint>",
])


def shingle_sets(c: Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    found = words(FOLD[c.data], c.bounds, SOLID)
    starts = row_starts(found.row, len(c.bounds) - 1)
    h, n = found.hash, len(found.hash)
    shingle = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
    for i in range(SHINGLE):
        shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + h[i : n - SHINGLE + 1 + i] if len(shingle) else shingle
    shingle = mix(shingle)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(shingle[a : b - SHINGLE + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = np.uint64((int(short) * 0x100000001B3 + int(x)) % (1 << 64))
            yield mix(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _minhash(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(DIGESTED, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(low), 512):
        least = np.minimum(least, ((low[i : i + 512, None] ^ _XOR) * _ODD).min(axis=0))
    return least


def _bits(values: np.ndarray) -> np.ndarray:
    """Two bits of each minhash as whole numbers, low bits first.

    They are mixed with the value's place: the low bits of a value are those of its shingle in every hash.
    """
    mixed = mix(values.astype(np.uint64) | (np.arange(DIGESTED, dtype=np.uint64) << np.uint64(32)))
    return np.concatenate([np.packbits(((mixed >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for k in (0, 1)])


def _first_nodes(values: np.ndarray) -> np.ndarray:
    """Names of the children of each tree's root."""
    at = np.arange(TREES * BRANCHES, dtype=np.uint64)
    return mix(values[: TREES * BRANCHES].astype(np.uint64) | (at << np.uint64(32))).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, set identity, digests, first tree nodes and minhash values of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SKETCH.split(", ")]
        for batch in batches:
            for c in chunks(batch.column(1)):
                size, a, b, digests, nodes, mins, small = [], [], [], [], [], [], []
                for s in shingle_sets(c):
                    size.append(len(s))
                    a.append(np.sum(mix(s ^ np.uint64(1)), dtype=np.uint64))
                    b.append(np.sum(mix(s ^ np.uint64(2)), dtype=np.uint64))
                    values = _minhash(s)
                    digests.append(_bits(values))
                    nodes.append(_first_nodes(values) if len(s) else np.zeros(0, np.int64))
                    mins.append(values[:HASHES].view(np.int32))
                    small.append(s.view(np.int64) if len(s) <= SMALL else None)
                digests = np.array(digests)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.first : c.last], pa.array(size, pa.int64()),
                     *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)),
                     *(pa.array(digests[:, k]) for k in range(N_DIGESTS)),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int32())),
                     pa.array(small, pa.list_(pa.int64()))], names,
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SKETCH)


def _is_sure(a: str, b: str) -> Column:
    """Whether a pair is decided by the sets that its rows carry."""
    return F.least(f"{a}.n_shingles", f"{b}.n_shingles") < LEAST_DIGESTED


def _alike(a: str, b: str) -> Column:
    """Whether two digests and set sizes allow a similarity of 0.75; whether they have it, if one set is small."""
    col = lambda side, name: F.col(f"{side}.{name}")
    unlike = lambda i: col(a, f"d{i}").bitwiseXOR(col(b, f"d{i}"))
    half = N_DIGESTS // 2
    different = sum((F.bit_count(unlike(i).bitwiseOR(unlike(i + half))) for i in range(half)), F.lit(0))
    n, m = col(a, "n_shingles"), col(b, "n_shingles")
    both = F.size(F.array_intersect(col(a, "small"), col(b, "small")))
    test = F.when(_is_sure(a, b), both * 100 >= (n + m - both) * 75).otherwise(different <= MOST_DIFFERENT)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 75) & test


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, text) of the distinct ids ``needed``, once each.

    A bit map of their hashes, which is broadcast, keeps nearly all other texts from being shuffled; the join is exact.
    """
    word, bit = F.expr(f"pmod(shiftright(xxhash64(doc_id), 6), {MAP_WORDS})"), F.expr("cast(pmod(xxhash64(doc_id), 64) AS int)")
    held = needed.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bits"))
    held = held.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    rows = docs.select("doc_id", "text", word.alias("_word")).join(F.broadcast(held), "_word").filter(F.getbit("_bits", bit) == 1)
    # No semi join: it would be pushed below the map and shuffle every text.
    return rows.select("doc_id", "text").join(needed, "doc_id").dropDuplicates(["doc_id"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 75 * union, on full sets."""
    if pairs.isEmpty():
        return pairs
    texts = settle(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((s for c in chunks(batch.column(k)) for s in shingle_sets(c)) for k in (2, 3))
            true = []
            for x, y in zip(*sets, strict=True):
                both_have = len(np.intersect1d(x, y, assume_unique=True))
                true.append(100 * both_have >= 75 * (len(x) + len(y) - both_have))
            yield batch.select(["a", "b"]).filter(pa.array(true, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def classes(links: DataFrame) -> DataFrame:
    """(id, component_id) of every linked id: the least id reachable, by alternating stars until nothing moves.

    In a star each id sends its neighbours to the least of them and itself; the
    least is an aggregate, so a centre of any degree is summed before it is shuffled.
    Edges form stars when each id has one way down and none comes from above it.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    while True:
        ends = edges.select(F.inline(F.array(
            F.struct(F.col("v").alias("id"), F.lit(1).alias("down")), F.struct(F.col("u").alias("id"), F.lit(0).alias("down"))
        )))
        ends = ends.groupBy("id").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
        if not ends.filter("down > 0 AND n > 1").agg(F.count(F.lit(1))).first()[0]:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(
                edges.select("u", "u").distinct().toDF("id", "component_id")
            )
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("centre")).agg(F.min("u").alias("m"))
        least = least.select("centre", F.least("centre", "m").alias("m"))
        # Larger neighbours go to the least of the neighbourhood.
        large = edges.join(least, edges.u == least.centre).select("v", F.col("m").alias("u")).filter("u < v").distinct()
        # Smaller neighbours, and the centre itself, go to the least of the smaller ones.
        small = large.groupBy(F.col("v").alias("centre")).agg(F.min("u").alias("m"))
        joined = large.join(small, large.v == small.centre)
        moved = joined.select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        edges = settle(moved)


def merged(found: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The classes of ``found`` (id, component_id) and of further ``links`` together.

    Links are taken between classes, so only the classes they touch are joined up anew.
    """
    if links.isEmpty():
        return found
    if found is None:
        return settle(classes(links))
    of = lambda k: found.select(F.col("id").alias(k), F.col("component_id").alias(f"of_{k}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = classes(ends)
    to = joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("to"))
    moved = found.join(to, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
    return settle(moved.unionByName(joined.join(found, "id", "left_anti")))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + length - 1`` of each range, one range after the other."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


class _Members(NamedTuple):
    """Members of leaf blocks as arrays, and the small sets of all, one after the other."""

    key: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    main: np.ndarray
    digests: np.ndarray
    flat: np.ndarray
    begin: np.ndarray


def _arrays(members: pa.Table) -> _Members:
    number = lambda name: members.column(name).to_numpy()
    sets = members.column("small").combine_chunks()
    return _Members(
        np.stack([number("node"), number("block")], axis=1), number("doc_id"), number("n_shingles"), number("class"), number("main"),
        np.stack([number(c) for c in DIGESTS], axis=1).view(np.uint64), sets.flatten().to_numpy(zero_copy_only=False),
        np.concatenate([[0], np.cumsum(sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]),
    )


class _Block:
    """The members of one leaf block, and what joins their classes."""

    def __init__(self, members: _Members, first: int, last: int):
        at = slice(first, last)
        self.doc, self.size, self.digests = members.doc[at], members.size[at], np.ascontiguousarray(members.digests[at].T)
        named, self.kind = np.unique(members.kind[at], return_inverse=True)
        self.main = members.kind[at] == members.main[at]
        self.is_first = members.key[first, 1] == 0
        begin = members.begin[first : last + 1]
        _, self.shingle = np.unique(members.flat[begin[0] : begin[-1]], return_inverse=True)
        self.begin = begin - begin[0]
        self.owner = np.repeat(np.arange(len(self.doc)), np.diff(begin))
        self.own = np.zeros(len(self.shingle), dtype=bool)
        self.joined = np.arange(len(named))  # classes that links so far make one

    @functools.cached_property
    def holders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that hold each shingle, one shingle after the other; where those of a shingle start, and how many they are."""
        n = np.bincount(self.shingle, minlength=len(self.own))
        return self.owner[np.argsort(self.shingle, kind="stable")], np.cumsum(n) - n, n

    def similar(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of the rows ``near`` that are links of row ``i``, by the sets that they carry.

        Either the sets of these rows are read, or the holders of the row's own shingles, whichever are fewer.
        """
        set_of = self.shingle[self.begin[i] : self.begin[i + 1]]
        holder, start, n = self.holders
        length = self.begin[near + 1] - self.begin[near]
        if length.sum() < n[set_of].sum():
            self.own[set_of] = True
            held = self.own[self.shingle[_ranges(self.begin[near], length)]]
            self.own[set_of] = False
            both = np.bincount(np.repeat(np.arange(len(near)), length)[held], minlength=len(near))
        else:
            both = np.bincount(holder[_ranges(start[set_of], n[set_of])], minlength=len(self.doc))[near]
        return near[both * 100 >= (self.size[near] + self.size[i] - both) * 75]

    def alike(self, i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows ``near`` whose digests are alike that of row ``i``, and in how many places they differ."""
        half, different = N_DIGESTS // 2, np.zeros(len(near), dtype=np.uint16)
        for k in range(half):
            if k == half // 2:  # most rows differ enough in half of the places
                left = different <= MOST_DIFFERENT
                near, different = near[left], different[left]
            unlike = (self.digests[k][near] ^ self.digests[k, i]) | (self.digests[k + half][near] ^ self.digests[k + half, i])
            different += np.bitwise_count(unlike)
        left = different <= MOST_DIFFERENT
        return near[left], different[left]

    def partners(self, apart: bool = False) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(i, rows, sure): the rows of other classes that row ``i``, which is not of the main class, is alike; with ``apart`` those not joined with it yet.

        Small sets are compared as sets, and their pairs are sure; else digests are compared, and the nearest rows come first.
        """
        size, kind = self.size, self.kind
        is_small, place = size < LEAST_DIGESTED, np.arange(len(size))
        for sure in (True, False):
            if not is_small.any() if sure else is_small.all():
                continue
            for i in np.flatnonzero(~self.main):
                near = self.joined[kind] != self.joined[kind[i]] if apart else kind != kind[i]
                near &= (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * 75) & ((is_small | is_small[i]) == sure)
                # Members outside the main class are in every block, and meet in the first one.
                near &= self.main | (self.is_first & (place > i))
                near = np.flatnonzero(near)
                if len(near) and sure:
                    near = self.similar(i, near)
                elif len(near):
                    near, different = self.alike(i, near)
                    near = near[np.argsort(different, kind="stable")]
                if len(near):
                    yield i, near, sure

    def apart(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of the rows ``near`` that nothing has joined with row ``i`` yet."""
        return near[self.joined[self.kind[near]] != self.joined[self.kind[i]]]

    def join(self, i: int, near: np.ndarray) -> np.ndarray:
        """Joins the classes of row ``i`` and of the rows ``near``; one row of each class that was apart."""
        near = self.apart(i, near)
        if not len(near):
            return near
        _, one = np.unique(self.joined[self.kind[near]], return_index=True)
        near = near[one]
        self.joined[np.isin(self.joined, self.joined[self.kind[near]])] = self.joined[self.kind[i]]
        return near

    def pairs(self, i: int, near: np.ndarray, sure: bool) -> Iterator[tuple[int, int, bool]]:
        return ((min(self.doc[i], self.doc[j]), max(self.doc[i], self.doc[j]), sure) for j in near)


def _compare(members: _Members, first: int, last: int, spanning: bool) -> list[tuple[int, int, bool]]:
    """(a, b, sure) of the alike pairs of different classes in the block of rows ``first`` to ``last`` - 1; one side is never of the main class.

    Small sets are compared as sets; of their links enough are returned to join what they join. With ``spanning`` the same
    holds for the pairs whose digests are alike.
    """
    block, out = _Block(members, first, last), []
    for i, near, sure in block.partners(apart=spanning):
        out.extend(block.pairs(i, block.join(i, near) if sure or spanning else near, sure))
    return out


def _alike_members(members: _Members, first: int, last: int) -> list[tuple[int, ...]]:
    """(node, main, doc_id, class, n_shingles, digests) of the members of a block whose digests are alike those of a member of another class."""
    block = _Block(members, first, last)
    found = np.zeros(last - first, dtype=bool)
    for i, near, sure in block.partners():
        if not sure:
            found[i] = found[near] = True
    at = first + np.flatnonzero(found)
    numbers = [members.key[at, 0], members.main[at], members.doc[at], members.kind[at], members.size[at]]
    return list(zip(*(x.tolist() for x in (*numbers, *members.digests[at].view(np.int64).T)), strict=True))


def _compare_sets(members: _Members, first: int, last: int) -> list[tuple[int, int]]:
    """Links of the block's members, which carry their full sets: enough to join what all links of alike pairs join."""
    block, out = _Block(members, first, last), []
    for i, near, sure in block.partners(apart=True):
        at, n = 0, len(near) if sure else FIRST_TESTED
        while at < len(near):  # a link to one of the nearest rows spares those of its class
            some = block.apart(i, near[at : at + n])
            links = some if sure or not len(some) else block.similar(i, some)
            out.extend((a, b) for a, b, _ in block.pairs(i, block.join(i, links), True))
            at, n = at + n, 4 * n
    return out


def _in_blocks(leaves: DataFrame, blocks: Column, work: Callable[[_Members, int, int], list[tuple]], ddl: str) -> DataFrame:
    """What ``work`` returns for every block of the leaves.

    The main class of a leaf is dealt over ``blocks``; the few other members are in each of them.
    """
    here = F.when(F.col("class") == F.col("main"), F.array(F.pmod(F.xxhash64("doc_id"), blocks))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    )
    dealt = leaves.select("node", F.explode(here).alias("block"), "main", *MEMBER)
    fields = [(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(ddl).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):  # blocks come one after the other; the last of a batch may go on
            if batch is not None and not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if held is not None:
                table = pa.concat_tables([held, table]) if table is not None else held
            if table is None:
                return
            members = _arrays(table)
            ends = np.flatnonzero((members.key[1:] != members.key[:-1]).any(axis=1)) + 1
            ends = np.concatenate([[0], ends, [len(members.key)] if batch is None else []]).astype(np.int64)
            out = [row for a, b in zip(ends[:-1], ends[1:], strict=True) for row in work(members, a, b)]
            held = table.slice(ends[-1]) if batch is not None else None
            columns = zip(*out, strict=True) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
            )

    blocked = dealt.repartition("node", "block").sortWithinPartitions("node", "block")
    return blocked.mapInArrow(run, ddl).distinct()


def _leaf_pairs(leaves: DataFrame, spanning: bool) -> DataFrame:
    """Pairs of different classes in leaves: one side is never of the main class."""
    blocks = F.floor(F.col("total") / BLOCK) + 1
    return _in_blocks(leaves, blocks, functools.partial(_compare, spanning=spanning), "a bigint, b bigint, sure boolean")


def _leaf_links(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Links (a, b) of different classes in leaves: enough to join what all links of large sets join.

    A group of near copies just below the limit has as many alike pairs as its size squared, so pairs never leave
    their block: the full set of each member that has an alike one goes to the blocks of its leaf, where pairs are tested.
    """
    names = ", ".join(f"{c} bigint" for c in ("node", "main", *MEMBER) if c != "small")
    alike = settle(_in_blocks(leaves, F.floor(F.col("total") / BLOCK) + 1, _alike_members, names))
    if alike.isEmpty():
        return alike.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                sets = pa.array([s.view(np.int64) for s in shingle_sets(c)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.first : c.last], sets], ["doc_id", "small"])

    sets = settle(_texts(docs, alike.select("doc_id").distinct()).mapInArrow(run, "doc_id bigint, small array<bigint>"))
    other = F.sum(F.when(F.col("class") != F.col("main"), F.col("n_shingles")).otherwise(0))
    of_node = alike.groupBy("node").agg(F.sum("n_shingles").alias("total"), other.alias("of_others"))
    blocks = F.floor(F.col("total") / F.greatest(F.lit(BLOCK_SHINGLES), F.col("of_others") * 4)) + 1
    return settle(_in_blocks(alike.join(of_node, "node").join(sets, "doc_id"), blocks, _compare_sets, "a bigint, b bigint"))


def _star_pairs(members: DataFrame, orders: list[Column]) -> DataFrame:
    """Each member of a tree node with the node's first members, one by each of ``orders``, if of another class."""
    first = [F.min(F.struct(order.alias("_order"), *MEMBER)).alias(f"c{i}") for i, order in enumerate(orders)]
    centre = members.groupBy("node").agg(*first)
    drawn = F.array(*[F.struct(*[f"c{i}.{c}" for c in MEMBER]) for i in range(len(orders))])
    centre = centre.select("node", F.explode(F.array_distinct(drawn)).alias("centre"))
    centre = settle(centre.select("node", "centre.*"))
    star = members.alias("a").join(centre.alias("b"), F.col("a.node") == F.col("b.node"))
    star = star.filter((F.col("a.class") != F.col("b.class")) & _alike("a", "b"))
    return star.select(
        F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"), _is_sure("a", "b").alias("sure")
    ).distinct()


def _links(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b, sure)."""
    return settle(confirmed(rows, pairs.filter("NOT sure").select("a", "b")).unionByName(pairs.filter("sure").select("a", "b")))


def _in_mixed_nodes(members: DataFrame) -> DataFrame:
    """Members (node, doc_id, class) of tree nodes that hold more than one class; with their number, its largest class and how many are not of it."""
    of_class = members.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"))
    of_node = of_class.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most"))
    of_node = of_node.filter(F.col("n") > F.col("most.n")).select(
        "node", (F.col("n") - F.col("most.n")).alias("others"), F.col("most.class").alias("main"), F.col("n").alias("total")
    )
    return members.select("node", "doc_id", "class").join(of_node, "node")


def _undecided(members: DataFrame, found: DataFrame | None, unique: DataFrame) -> DataFrame:
    """Members with their class, of tree nodes that hold more than one class.

    Most nodes hold one class only, so sketches meet the members (node, doc_id, class) that are left, from ``unique``.
    """
    if found is not None:
        known = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("class"))
        members = members.drop("class").join(known, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    return settle(_in_mixed_nodes(members).join(unique.select(*[c for c in MEMBER if c != "class"]), "doc_id"))


def branches(wide: DataFrame, looked_at: int = 32) -> DataFrame:
    """(node, positions): the minhash positions at which a node branches, chosen by the node's name.

    A position at which most members agree (of ``looked_at``, by hash) splits
    nothing: a passage that all members share takes such positions. The others
    are drawn from, and more of them, so that a pair of similarity 0.75, which
    agrees on 96 of the 128, still loses a branch with probability 1/9 at most.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "doc_id")))
    few = wide.select("node", "mins", place.alias("place")).filter(F.col("place") <= looked_at).drop("place")

    def choose(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        mins = np.array(table.column("mins").to_pylist(), dtype=np.int32)
        agree = (mins[:, None, :] == mins[None, :, :]).sum(axis=0).max(axis=0)
        free = np.flatnonzero(agree * 2 <= len(mins))
        shared = (0.75 * HASHES - (HASHES - len(free))) / max(1, len(free))
        if shared < 0.05:  # members alike almost everywhere
            free, shared = np.arange(HASHES), 0.75
        n = max(BRANCHES, int(np.ceil(np.log(1 / 9) / np.log(1 - shared))))
        drawn = np.random.default_rng(node % (1 << 63)).permutation(free)[:n]
        return pa.table({"node": [node], "positions": [drawn.astype(np.int32)]})

    return few.groupBy("node").applyInArrow(choose, "node bigint, positions array<int>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_copies of the set, for every row of ``docs``."""
    let_go(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = settle(sketches(rows))
    named = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # One node of the graph per distinct set: its least doc_id.
    least = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("n_copies"))
    least = settle(least)
    unique = named.join(least.select("doc_id"), "doc_id", "left_semi").select("doc_id", "nodes").dropDuplicates(["doc_id"])
    members = unique.select("doc_id", F.col("doc_id").alias("class"), F.explode("nodes").alias("node"))
    members = settle(_in_mixed_nodes(members).select("node", "doc_id", "class"))
    unique = named.drop("set_a", "set_b", "nodes").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    unique = settle(unique.dropDuplicates(["doc_id"]))
    members = _undecided(members, None, unique)
    let_go(docs.sparkSession)
    orders = [F.lit(0), *(F.xxhash64("doc_id", F.lit(turn)) for turn in range(TURNS))]
    tested = settle(_star_pairs(members, orders))
    found = merged(None, _links(rows, tested))
    depth = 1
    while True:
        let_go(docs.sparkSession)
        members = _undecided(members, found, unique)
        small = (F.col("others") <= LEAF) if depth < DEEPEST else F.lit(True)
        wide = members.filter(~small)
        pairs = leaf = settle(_leaf_pairs(members.filter(small), spanning=True))
        deeper = not wide.isEmpty()
        if deeper:
            pairs = pairs.union(_star_pairs(wide, [F.xxhash64("node", "doc_id")])).distinct()
        pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        links = _links(rows, pairs)
        found = merged(found, links)
        if not leaf.filter("NOT sure").join(links, ["a", "b"], "left_anti").isEmpty():
            # A pair that is no link may have stood for others.
            let_go(docs.sparkSession)
            found = merged(found, _leaf_links(rows, _undecided(members.filter(small), found, unique)))
        if not deeper:
            break
        wide = _undecided(wide, found, unique)
        if wide.isEmpty():
            break
        wide = settle(wide.select("node", "doc_id", "class").join(unique.select("doc_id", "mins"), "doc_id"))
        grown = wide.join(branches(wide), "node").withColumn("at", F.explode("positions"))
        grown = grown.withColumn("node", F.xxhash64("node", "at", F.get("mins", F.col("at"))))
        members = grown.select("node", "doc_id", "class")
        depth += 1

    if found is None:
        found = least.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component_id"))
    node = least.join(found, least.doc_id == found.id, "left").select(
        "set_a", "set_b", "n_copies", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    out = every.select("doc_id", "n_shingles", "set_a", "set_b").join(
        node, (every.set_a == node.set_a) & (every.set_b == node.set_b) & (every.n_shingles > 0), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
    )
