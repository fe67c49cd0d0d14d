"""Shards of equal row counts that keep linked documents together: balanced label propagation.

Documents are linked by equal texts and by shared least shingles: the ``KEPT`` smallest hashes of a text's distinct
five-word shingles. A link is a feature that several nodes have, not a pair, so a group of any
size costs one row a member. Documents with equal texts are one node of the graph; only a group beyond 1/1024 of all rows is
several nodes, cut by hash and linked by its text.

Every node starts at a shard named by its least shared feature. A round sums, for each feature, the rows in
each shard, joins the sums back to the feature's nodes and adds them up per node: a node wants the shard
where most of its neighbours are (a feature of n rows counts 1 / (n - 1) for each). Rounds alternate between moves to smaller and to
larger numbers, so that two neighbours never swap. Wishes are summed by (from, to, gain level), at most 16 x 15 x ``LEVELS`` rows;
the driver grants them from the largest gain down while the shard aimed at has room, the last
level in part, by hash.

At the end every shard keeps as many rows as its quota, whole groups as far as possible; the rest of an overfull
shard, then the documents without links, fill the free places in order. So counts differ by one at
most (law ``rows``), and a group is cut only if it is split above or lies on one of the borders between shards. Slots
are places in that order. Order runs over at most 34 x 4096 hash buckets and the nodes of split groups, never over a whole shard in one task.

A null text counts as an empty one. Texts without words have no shingle, and those of
under five words the whole sequence as one. Repeated rows are rows of their own, told apart by where they were
read. Null ids are kept. An empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.llm.arrays import chunks
from markwise.llm.columns import settle
from markwise.llm.minhash_dedup import shingle_sets

SHARDS = 16
KEPT = 4
ROUNDS = 8
LEVELS = 16
BUCKETS = 4096
#: Most features whose nodes are salted, and most groups (a quarter as many) that are several nodes; both are broadcast.
HOT = 4096


def _least_shingles(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The smallest shingle hashes of each text."""
    for column in texts:
        found = [s[:KEPT].view("int64") for c in chunks(column) for s in shingle_sets(c)]
        yield pa.array(found, pa.list_(pa.int64()))


def least_shingles(text: Column) -> Column:
    return F.arrow_udf(_least_shingles, "array<bigint>")(text)


def _rows(docs: DataFrame) -> DataFrame:
    """One narrow row per document: place read, id, size, checksum, hash of the text, features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return settle(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("group"), least_shingles(text).alias("features"),
    ))


def _nodes(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their node, and the nodes (node, weight, features)."""
    most = max(8, n_rows // (HOT // 4))
    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    # At most HOT / 4 groups can have more than that share of all rows.
    large = F.broadcast(large.select("group", F.ceil(F.col("n") / most).alias("parts")))
    rows = rows.join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), "parts")).withColumn("node", F.xxhash64("group", "part"))
    shared = F.when(F.col("parts") > 1, F.array_append("features", F.xxhash64("group"))).otherwise(F.col("features"))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.first(shared).alias("features"))
    return rows.drop("features"), settle(nodes)


def links(nodes: DataFrame) -> DataFrame:
    """(feature, salt, salts, total, node, weight) of every feature that several nodes have; total: its rows.

    The nodes of a feature with over 1/4096 of all pins are dealt over several salts.
    """
    pins = settle(nodes.select("node", "weight", F.explode(F.array_distinct("features")).alias("feature")))
    most = max(1000, pins.count() // HOT)
    counts = pins.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")).filter("n > 1")
    counts = settle(counts.withColumn("salts", F.floor(F.col("n") / most) + 1))
    hot = F.broadcast(counts.filter("salts > 1").select("feature", F.col("salts").alias("s")))
    dealt = pins.join(hot, "feature", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("s", F.lit(1)))).drop("s")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("n")
    return settle(dealt.join(salted, ["feature", "salt"]))


def _level(gain: Column) -> Column:
    """0 (largest) to LEVELS - 1 by halves of the gain."""
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(F.lit(4.0) - F.log2(gain)))).cast("int")


def _wishes(edges: DataFrame, turn: int) -> DataFrame:
    """(node, weight, shard, to, gain) after one round of joins; to and gain are null for nodes that stay."""
    here = [F.sum(F.when(F.col("shard") == i, F.col("weight")).otherwise(0)).alias(f"h{i}") for i in range(SHARDS)]
    sums = edges.groupBy("feature").agg(F.first("salts").alias("salts"), *here)
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    seen = edges.join(sums, ["feature", "salt"])
    others = lambda i: F.col(f"h{i}") - F.when(F.col("shard") == i, F.col("weight")).otherwise(0)
    node = seen.groupBy("node").agg(
        F.first("weight").alias("weight"), F.first("shard").alias("shard"),
        *(F.sum(others(i) / (F.col("total") - F.col("weight"))).alias(f"v{i}") for i in range(SHARDS)),
    )
    now = F.element_at(F.array(*[f"v{i}" for i in range(SHARDS)]), F.col("shard") + 1)
    side = (lambda i: F.col("shard") > i) if turn % 2 == 0 else (lambda i: F.col("shard") < i)
    best = F.array_max(F.array(*[
        F.when(side(i), F.struct((F.col(f"v{i}") - now).alias("gain"), F.lit(i).alias("to"))) for i in range(SHARDS)
    ]))
    node = node.withColumn("best", best)
    wish = F.col("best.gain") > 1e-9
    return settle(node.select(
        "node", "weight", "shard", F.when(wish, F.col("best.to")).alias("to"), F.when(wish, F.col("best.gain")).alias("gain")
    ))


def grants(demand: list[tuple[int, int, int, int]], load: list[int], room: int) -> dict[tuple[int, int], float]:
    """The share of each (to, level) that may move: demand is (from, to, level, rows), ``room`` rows fit into a shard."""
    load, share = list(load), {}
    for level in sorted({d[2] for d in demand}):
        now = [d for d in demand if d[2] == level]
        asked = [sum(n for _, to, _, n in now if to == s) for s in range(len(load))]
        part = [min(1.0, max(0, room - held) / want) if want else 0.0 for held, want in zip(load, asked, strict=True)]
        for source, to, _, n in now:
            load[source] -= n * part[to]
            load[to] += n * part[to]
        share |= {(s, level): p for s, p in enumerate(part) if p > 0}
    return share


def propagate(edges: DataFrame, n_rows: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of every node with links."""
    room, still = -(-n_rows // SHARDS), 0
    state = edges.groupBy("node").agg(F.min("feature").alias("least"))
    state = settle(state.select("node", F.pmod(F.xxhash64("least"), F.lit(SHARDS)).cast("int").alias("shard")))
    for turn in range(rounds):
        wishes = _wishes(settle(edges.join(state, "node")), turn)
        load = [0] * SHARDS
        for shard, n in wishes.groupBy("shard").agg(F.sum("weight")).collect():
            load[shard] = n
        asked = wishes.filter("to IS NOT NULL").withColumn("level", _level(F.col("gain")))
        share = grants([tuple(d) for d in asked.groupBy("shard", "to", "level").agg(F.sum("weight")).collect()], load, room)
        still = 0 if share else still + 1
        if still == 2:
            break
        if not share:
            continue
        part = F.create_map(*(F.lit(x) for (to, level), p in share.items() for x in (to * LEVELS + level, p)))
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        granted = F.coalesce(drawn < F.element_at(part, F.col("to") * LEVELS + _level(F.col("gain"))), F.lit(False))
        state = settle(wishes.select("node", F.when(granted, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return state


def _placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (row, group, node, weight, parts, part, shard or null) with the final shard and slot.

    In a shard, copies come first, then single documents, then parts of split groups: what has to leave is the last.
    """
    place = F.coalesce(F.col("shard"), F.lit(SHARDS))
    kind = F.when(F.col("parts") > 1, 2).when(F.col("weight") > 1, 0).otherwise(1)
    bucket = ["place", "kind", "bucket", "part"]
    rows = settle(rows.withColumn("place", place).withColumn("kind", kind).withColumn(
        "bucket", F.pmod(F.xxhash64("group"), F.lit(BUCKETS))
    ))
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("place").orderBy(*bucket[1:]))
    # At most 34 x BUCKETS rows, and those of at most HOT / 4 split groups (at most HOT / 2 nodes) again.
    before = F.broadcast(counts.select(*bucket, (upto - F.col("held")).alias("before")))
    own = F.row_number().over(Window.partitionBy(*bucket).orderBy("group", "row")) - 1
    rows = rows.withColumn("own", own).join(before, bucket).withColumn("rank", F.col("own") + F.col("before"))

    load = [0] * (SHARDS + 1)
    for p, n in counts.groupBy("place").agg(F.sum("held")).collect():
        load[p] = n
    fullest = sorted(range(SHARDS), key=lambda s: (-load[s], s))[: n_rows % SHARDS]
    quota = [n_rows // SHARDS + (s in fullest) for s in range(SHARDS)]
    kept = [min(q, n) for q, n in zip(quota, load, strict=False)]
    over = [0, *accumulate(n - k for n, k in zip(load[:SHARDS], kept, strict=True))]
    # Free places in the order they are filled: those of the emptiest shard first, so that a large rest is cut least.
    emptiest = sorted(range(SHARDS), key=lambda s: (kept[s] - quota[s], s))
    free = [0, *accumulate(quota[s] - kept[s] for s in emptiest)]

    pick = lambda values, at: F.element_at(F.array(*(F.lit(v).cast("bigint") for v in values)), at + 1)
    stays = F.col("rank") < pick([*kept, 0], F.col("place"))
    queue = F.col("rank") - pick([*kept, 0], F.col("place")) + pick(over, F.col("place"))
    turn = sum((F.when(queue >= end, 1).otherwise(0) for end in free[1:-1]), F.lit(0))
    rows = rows.withColumn("stays", stays).withColumn("queue", queue).withColumn("turn", turn)
    shard = F.when(F.col("stays"), F.col("place")).otherwise(pick(emptiest, F.col("turn")))
    first = [kept[s] - before for s, before in zip(emptiest, free, strict=False)]
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(F.col("queue") + pick(first, F.col("turn")))
    return rows.withColumn("final", shard.cast("int")).withColumn("slot", slot.cast("bigint"))


def shard_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), text_group and linked, for every row of ``docs``."""
    rows = _rows(docs)
    n_rows = rows.count()
    rows, nodes = _nodes(rows, n_rows)
    rows = rows.join(nodes.select("node", "weight").join(propagate(links(nodes), n_rows, rounds), "node", "left"), "node")
    return _placed(rows, n_rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("final").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("group").alias("text_group"), F.col("shard").isNotNull().alias("linked"),
    )
