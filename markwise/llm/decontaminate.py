"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``size`` consecutive words of an item (all of a shorter item). A
document holds a window only if it holds every word of it, so the prefix that a
join needs is one word: the rarest one by its count in all documents. Windows
are keyed by that word and its place in the window. A document word that equals
it gives a start by position; the window must fit between the document's ends
(length bound), and its words must stand there one by one (exact check).

Texts are cut as they are, so that no letter's case depends on what stands around
its word. Candidates are looked up by each word's own Unicode lower case, which is
the same for words that differ in A-Z and a-z only; the exact check lower-cases A-Z
only. Null texts have no words; items
without words and null item_ids match nothing. Repeated rows give repeated results. Rows
with a null doc_id are matched together as one document. An empty table of documents
gives no rows, one of items no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.llm.columns import settle

#: Capital letters belong to words: this cuts a text where the folded text is cut.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the prefix table that may be sent to every task (a row is some 250 bytes); a larger one is shuffled.
MOST_SENT = 200_000
#: Candidates of a document, about, that meet one copy of it where the prefix table is shuffled.
PER_ROW = 10_000


def word_array(text: Column) -> Column:
    """Words of a text as an array; a leading or trailing separator leaves an empty first or last entry."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def _lead(parts: Column) -> Column:
    return F.when(F.element_at(parts, 1) == "", 1).otherwise(0)


def _n_words(parts: Column) -> Column:
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.size(parts) - _lead(parts) - last


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: key text (words joined by a blank), words, and the items that hold them."""
    parts = items.filter(F.col("item_id").isNotNull()).select("item_id", word_array(fold(F.col("text"))).alias("parts"))
    rows = parts.select("item_id", F.slice("parts", _lead(F.col("parts")) + 1, _n_words(F.col("parts"))).alias("words"))
    rows = rows.filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = rows.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    cut = starts.select("item_id", F.slice("words", F.col("start") + 1, size).alias("window"))
    return cut.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).select(
        F.array_join("window", " ").alias("window"), F.size("window").alias("n"), "items"
    )


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(word_array(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))


def _sent(spark_rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(spark_rows) if n <= MOST_SENT else spark_rows


def prefixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each window with its rarest word over all documents and that word's place (0-based)."""
    spread = found.select("window", F.posexplode(F.split("window", " ")).alias("place", "word"))
    spread = spread.withColumn("word", F.lower("word"))
    vocabulary = spread.select("word").distinct()
    n = vocabulary.count()
    counts = _document_words(docs).join(_sent(vocabulary, n), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(counts, "word", "left").select(
        "window", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "place").alias("rank")
    )
    rarest = ranked.groupBy("window").agg(F.min("rank").alias("rank"))
    return rarest.select("window", F.col("rank.word").alias("word"), F.col("rank.place").alias("place"))


def matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, n, window): where a document holds one of the windows ``found``; ``start`` counts words from 0."""
    keyed = settle(prefixes(docs, found).join(found.select("window", "n"), "window"))
    n = keyed.count()
    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("name"), word_array(F.col("text")).alias("parts"))
    lead, total = _lead(F.col("parts")), _n_words(F.col("parts"))
    # A word carries its document only where it stays in its task.
    carried = ["doc_id", "parts"] if n <= MOST_SENT else ["name"]
    spread = named.select(
        *carried, lead.alias("lead"), total.alias("total"), F.posexplode("parts").alias("at", "word")
    ).withColumn("word", F.lower("word"))
    start = F.col("at") - F.col("lead") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.col("total"))
    candidates = spread.join(_sent(keyed, n), "word").filter(fits).withColumn("start", start)
    if n > MOST_SENT:
        candidates = _with_documents(candidates, named.withColumn("lead", lead))
    there = F.array_join(F.slice("parts", F.col("lead") + F.col("start") + 1, F.col("n")), " ")
    return candidates.filter(fold(there) == F.col("window")).select("doc_id", "start", "n", "window")


def _with_documents(candidates: DataFrame, named: DataFrame) -> DataFrame:
    """Candidates with the documents of their name, each sent once for up to ``PER_ROW`` candidates.

    Documents of one name are copies, or of equal hash: then the exact check tells them apart.
    """
    distinct = settle(candidates.select("name", "start", "n", "window").distinct())
    part = F.pmod(F.xxhash64("start", "window"), F.greatest(F.lit(1), F.ceil(F.col("held") / PER_ROW)))
    held = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("held"))
    lists = distinct.join(held, "name").groupBy("name", part.alias("part")).agg(
        F.collect_list(F.struct("start", "n", "window")).alias("found")
    )
    met = named.join(lists.select("name", "found"), "name")
    return met.select("doc_id", "parts", "lead", F.inline("found"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Words, hit words and items found, of every document; the hash of no items is that of the empty text."""
    rows = docs.select("doc_id", "text")
    found = settle(windows(items, size))
    hits = settle(matches(rows, found))
    covered = (
        hits.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
        .distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    held = (
        hits.select("doc_id", "window").distinct().join(found.select("window", "items"), "window")
        .select("doc_id", F.explode("items").alias("item")).distinct()
        .groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    marks = covered.join(held, covered.doc_id.eqNullSafe(held.doc_id)).select(
        covered.doc_id.alias("hit_id"), "n_hit", "items"
    )
    n_words = _n_words(word_array(F.col("text"))).cast("bigint")
    flat = rows.select("doc_id", n_words.alias("n_words"))
    joined = flat.join(marks, flat.doc_id.eqNullSafe(marks.hit_id), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
