"""Shards, the hash tree and centroids: against plain Python, on groups of copies, and on awkward tables."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise.llm import centroids, merkle, sharding
from markwise.llm.queries import QUERIES
from tests.oracle import TESTDATA, compare, connect

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, several small sources, and columns named like the operators' own."""
    long = "Ab cd " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, long, "en", "b", len(long)), (3, long, "en", "b", len(long)),
            (None, "X y", "de", "b", 3), (None, None, None, None, None), (4, "ß — É", "fr", "é", 5), (4, "other", "fr", "é", 5)]
    rows += [(100 + i, f"Text {i} " * 9, "en", "b", 5) for i in range(40)]
    frame = spark.createDataFrame(rows, ROW)
    for name in ("id", "idx", "n", "tree", "_tie", "slice", "row", "group", "node", "part", "shard", "slot", "leaf", "path"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_orchard"])
def test_sql_twins(spark, name):
    assert compare(QUERIES[name].build(spark, SF), connect(SF), QUERIES[name].sql) == []


def plain_manifest(rows):
    """Every tree whole in memory."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
        return found

    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: levels([leaf(r, r.text) for r in own]) for s, own in sources.items()}
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            now, siblings = trees[s][0][i], ""
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                now = leaf(r, low(r.text))
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run, q = level[at // 16 * 16 :][:16], at % 16
                    siblings += "".join(run[:q] + run[q + 1 :])
                    now, at = sha("".join([*run[:q], now, *run[q + 1 :]])), at // 16
            yield r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]


def test_compression():
    """Whole blocks, one by one and in tiles, against the library's digests."""
    texts = [bytes([i % 251]) * 64 * (i % 5 + 1) for i in range(300)]
    for n in range(1, 6):
        own = [t for t in texts if len(t) == 64 * n]
        state = np.repeat(merkle.START[None, :], len(own), axis=0)
        blocks = np.array([np.frombuffer(t, ">u4").reshape(n, 16) for t in own]).astype(np.uint32)
        for k in range(n):
            state = merkle.compress(state, blocks[:, k])
        state = merkle.compress(state, merkle._closing(np.full(len(own), n)))
        assert [bytes(x).decode() for x in merkle._hex(state)] == [hashlib.sha256(t).hexdigest() for t in own]


def test_manifest_of_awkward_rows(spark, odd):
    assert rows_of(merkle.manifest(odd)) == sorted(plain_manifest(odd.collect()), key=str)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(7, "A b", "en", "s", 3)], ROW)
    assert rows_of(merkle.manifest(one)) == list(plain_manifest(one.collect()))
    assert merkle.manifest(one.limit(0)).count() == 0


def test_manifest_of_many_sources(spark):
    """Over 16 sources: the tree above the subroots has several levels; a hot one has a third of all rows."""
    rows = [(i, f"Row {i}", None, None if i % 3 == 0 else f"s{i % 40}", i) for i in range(900)]
    frame = spark.createDataFrame(rows, ROW).repartition(7)
    assert rows_of(merkle.manifest(frame)) == sorted(plain_manifest(frame.collect()), key=str)


def check_shards(rows, n_rows):
    by = {}
    for r in rows:
        assert (r.law, r.grown_shard) == ("rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, ())) for s in range(16)]
    assert sum(sizes) == n_rows and set(by) <= set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op11_label_propagation"].build(spark, SF).collect()
    check_shards(rows, docs.count())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items())
    group = {}
    for r in rows:
        group.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in group.values()) <= 3  # those on a border between shards


def test_shards_keep_linked_documents(spark):
    """Families that share passages, and one text on a third of all rows: few links are cut, and the large group is cut least."""
    def text(family, i):
        return " ".join([*(f"f{family}w{j}" for j in range(40)), *(f"own{family}-{i}-{j}" for j in range(3))])

    rows = [(1000 * f + i, text(f, i)) for f in range(60) for i in range(10)]
    rows += [(200_000 + i, f"alone {i} a b c d e f") for i in range(400)]
    rows += [(100_000 + i, "the same words in every one of these rows") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.shard_documents(frame).collect()
    check_shards(got, len(rows))
    shard = {r.doc_id: r.shard for r in got}
    families = [Counter(shard[1000 * f + i] for i in range(10)) for f in range(60)]
    kept = sum(max(c.values()) for c in families)
    assert kept >= 0.9 * 600
    assert len({shard[i] for i in shard if 100_000 <= i < 200_000}) <= 9  # six shards' worth, of which families fill a third


def test_grants_stay_within_room():
    share = sharding.grants([(0, 1, 0, 60), (2, 1, 0, 60), (0, 1, 3, 50), (3, 2, 3, 10)], [100, 40, 80, 20], 100)
    assert share == {(1, 0): 0.5, (2, 3): 1.0}


def test_shards_of_awkward_rows(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    check_shards(rows, odd.count())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()
    )
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    at = [x for _, x in sorted((sha(f"1:{'' if i is None else i}"), x) for i, x in kept)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        for n, xs in own.items():
            at[n] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = Counter()
    for _, c, d in found:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, at[c])))) for i, c, d in found), key=str)


def test_clusters_of_awkward_vectors(spark):
    """Ties, repeated rows, null ids, and vectors that are short, null, or hold null or infinite values."""
    draw = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in draw.integers(-2, 3, (60, 64)) / 16]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(5, vectors[5])] * 3 + [(None, vectors[7]), (None, None), (70, []), (71, [1.0] * 63)]
    rows += [(72, [*vectors[0][:63], None]), (73, [*vectors[0][:63], math.inf]), (74, [*vectors[0][:63], math.nan]), (75, [0.0] * 65)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name in ("id", "at", "cluster", "distance", "name"):
        frame = frame.withColumn(name, F.lit("x"))
    assert rows_of(centroids.cluster(frame)) == plain_clusters(rows)
    few = frame.filter("vec_id < 5")
    assert rows_of(centroids.cluster(few)) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 5])
    assert centroids.cluster(frame.limit(0)).count() == 0


def test_search_measures_less_and_finds_all():
    draw = np.random.default_rng(5)
    at = draw.integers(-40, 40, (50, 64))
    x = at[draw.integers(0, 50, 3000)] + draw.integers(-3, 4, (3000, 64))
    best, distance, measured = centroids.search(x, centroids.lists(at))
    every = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.75 * every.size


def test_search_ties_go_to_the_smaller_number():
    at = np.array([[4], [-4], [4], [0], [8]])
    best, distance, _ = centroids.search(np.array([[4], [2], [-2], [6], [100], [-100]]), centroids.lists(at))
    assert best.tolist() == [0, 0, 1, 0, 4, 1] and distance.tolist() == [0, 4, 4, 4, 92**2, 96**2]


def test_centroids_refuse_what_is_not_exact(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(frame).count()
