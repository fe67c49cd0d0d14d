"""A training corpus from raw documents, in five written stages.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents`` (all columns but in suffix_dedup, which returns these
five); the last returns packed pieces. Rows that a stage has no reason to reject
stay, those with null texts and null ids included. A repeated doc_id is a near
duplicate of itself: one row of it stays. Rows without a doc_id are never merged.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.llm import decontaminate, minhash_dedup, packing, suffix_dedup, toxicity
from markwise.llm.columns import settle, small_batches
from markwise.llm.queries import _tokenizer
from markwise.plans.catalog import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    graded = whole.withColumn("found", toxicity.grade(model, F.col("row.text")))
    return graded.filter(~F.col("found.toxic")).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id, once."""
    gone = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of every text; half characters at the edges of a cut go with it.

    They turn into U+FFFD, which is then removed, also where a cut text held it before.
    """
    rows = suffix_dedup.remove_repeats(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    valid = F.replace(F.make_valid_utf8(F.col("cut.kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    cut = F.when(F.col("cut.n_removed") > 0, valid).otherwise(F.col("text"))
    return rows.select("doc_id", cut.alias("text"), "lang", "source", F.char_length(cut).cast("bigint").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    marks = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = settle(marks.filter("contaminated").select("doc_id").distinct())
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.doc_id), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences of at most 4096."""
    return packing.pack(docs, _tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", small_batches(toxicity_stage)),
    ("near_duplicates", small_batches(near_duplicate_stage)),
    ("suffix_dedup", small_batches(suffix_stage)),
    ("decontamination", small_batches(decontamination_stage)),
    ("packing", small_batches(packing_stage)),
]

#: The severity model and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
