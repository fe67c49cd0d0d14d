"""Order MinHash fingerprints in DataFrame operations only.

A text's k-mers are runs of ``K`` words (cut at ASCII white space; all words of a
shorter text), each numbered by its occurrence, so that repeats count. One
sketch takes the minimal numbered k-mer under each of two hash orders and hashes
the two in their order in the text. Two texts agree on a sketch if they share
both k-mers in the same order, so the share of equal sketches falls with edits
and with moved passages alike.

A null text is empty; an empty text has the fingerprint of no k-mers, which only
empty texts share. Places beyond 2**24 words wrap around. Repeated rows give
one row each; a null doc_id sorts last; rows of one doc_id are ordered by text.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
SKETCHES = 32
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
WHITE = r"[\x20\x09-\x0D]+"


def _masks() -> list[int]:
    """Two hash orders for each sketch: a k-mer's hash is compared after an exclusive or with the mask."""
    draw = random.Random(9)
    return [(draw.getrandbits(64) - (1 << 63)) & ~PLACE for _ in range(2 * SKETCHES)]


def _hash_of(value: Column) -> Column:
    return value.bitwiseAND(F.lit(~PLACE))


def kmers(words: Column) -> Column:
    """Sorted array of (hash of the k-mer, place of its first word), both in one number."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(1)))
    return F.sort_array(F.transform(
        starts, lambda _, i: _hash_of(F.xxhash64(F.slice(words, i + 1, K))).bitwiseOR(i.cast("bigint").bitwiseAND(F.lit(PLACE)))
    ))


def numbered(found: Column) -> Column:
    """Sorted k-mers with the occurrence number in the hash: the n-th copy of a k-mer differs from the others.

    Copies are neighbours; how many stand before one is found by halving steps.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(PLACE_BITS - 1, -1, -1)])

    def number(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(_hash_of(F.get(found, j)) == _hash_of(x), F.lit(False))
        before = F.aggregate(
            steps, F.lit(0), lambda n, step: F.when((i - n >= step) & same(i - n - step), n + step).otherwise(n)
        )
        again = _hash_of(F.xxhash64(_hash_of(x), before)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))
        return F.when((i > 0) & same(i - 1), again).otherwise(x)

    return F.transform(found, number)


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint of each row: 8 hex digits a sketch. ``keys`` must name each row."""
    words = rows.select(*keys, F.split(F.col(text), WHITE).alias("_words"), (F.col(text) == "").alias("_none"))
    found = words.select(*keys, F.when(~F.col("_none"), kmers(F.col("_words"))).alias("_found"))
    spread = found.select(*keys, numbered(F.col("_found")).alias("_kmers")).select(
        *keys, F.explode_outer("_kmers").alias("_kmer")
    )
    least = spread.groupBy(*keys).agg(
        *[F.min(F.col("_kmer").bitwiseXOR(F.lit(m))).alias(f"_m{i}") for i, m in enumerate(_masks())]
    )
    parts = []
    for i in range(SKETCHES):
        a, b = F.col(f"_m{2 * i}"), F.col(f"_m{2 * i + 1}")
        forward = a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE))
        first, second = F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a)
        pair = F.xxhash64(_hash_of(first), _hash_of(second)).bitwiseAND(F.lit(0xFFFFFFFF))
        parts.append(F.lpad(F.hex(pair), 8, "0"))
    return least.select(*keys, F.lower(F.concat(*parts)).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches of two fingerprints."""
    equal = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(SKETCHES)]
    return F.round(sum(equal[1:], equal[0]) / F.lit(float(SKETCHES)), 6)


def in_slices(docs: DataFrame) -> DataFrame:
    """Documents in slices of the descending order of doc_id, each with the first row of the next slice as a guest.

    Slice bounds are quantiles of doc_id, as many as there are shuffle
    partitions; guests are one row a slice. So a window over a slice sees every
    row's successor, and no task sees more than a slice.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.lit(-(1 << 63))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "_key", F.coalesce(F.col("doc_id").cast("bigint"), lowest)
    )
    bounds = sorted(set(rows.approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n)), reverse=True)
    inner = F.lit(0)
    for b in bounds:
        inner = inner + (F.col("_key") < F.lit(int(b))).cast("int")
    rows = rows.withColumn("_slice", inner)
    first = [(r["_slice"], r["_key"]) for r in rows.groupBy("_slice").agg(F.max("_key").alias("_key")).collect()]
    if not first:
        return rows.withColumn("_guest", F.lit(False))
    first.sort()
    hosts = [(first[i - 1][0], key) for i, (_, key) in enumerate(first)]  # the last slice hosts the first row of all
    wanted = docs.sparkSession.createDataFrame(hosts, "_host int, _key bigint")
    guests = rows.join(F.broadcast(wanted), "_key").groupBy("_host", "_key").agg(F.min("text").alias("text"))
    guests = guests.select(
        F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", "_key",
        F.col("_host").alias("_slice"), F.lit(True).alias("_guest"),
    )
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document."""
    order = Window.partitionBy("_slice").orderBy("_guest", F.desc("_key"), "text")
    placed = in_slices(docs).select(
        "_slice", "doc_id", "_guest", "text", F.row_number().over(order).alias("_at"), F.lead("text").over(order).alias("_next"),
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("_next", F.lit("")), half)
    )
    both = placed.select("_slice", "_at", "doc_id", "_guest", "n_chars", "text", edited.alias("_edited"))
    both = both.withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = ["_slice", "_at", "doc_id", "_guest", "n_chars", "edited_sha256"]
    sides = both.select(*keys, F.posexplode(F.array("text", "_edited")).alias("_side", "_text"))
    prints = fingerprint(sides, [*keys, "_side"], "_text")
    pairs = prints.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("_side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    following = F.lead("fingerprint").over(Window.partitionBy("_slice").orderBy("_at"))
    out = pairs.withColumn("_following", following).filter(~F.col("_guest"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
    )
