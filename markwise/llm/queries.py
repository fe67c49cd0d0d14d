"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.llm import (
    centroids, decontaminate, importance, language_id, licenses, lm_scoring, merkle, minhash_dedup, order_minhash, packing,
    sharding, sql, suffix_dedup, toxicity,
)
from markwise.llm.columns import small_batches
from markwise.plans.catalog import Query, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_dedup(spark, sf):
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"))


def op2_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


def op3_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), _tokenizer())


def op4_suffix_dedup(spark, sf):
    rows = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


def op5_toxicity(spark, sf):
    return toxicity.grade_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_importance(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_decontaminate(spark, sf):
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_language_id(spark, sf):
    return language_id.identify_languages(table(spark, sf, "documents"))


def op9_order_minhash(spark, sf):
    return order_minhash.fingerprint_documents(table(spark, sf, "documents"))


def op10_lm_scoring(spark, sf):
    return lm_scoring.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_label_propagation(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"))


def op12_merkle_manifest(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"))


def op13_orchard(spark, sf):
    return centroids.cluster(table(spark, sf, "embeddings"))


SQL = {"op12_merkle_manifest": sql.OP12_MERKLE_MANIFEST, "op13_orchard": sql.OP13_ORCHARD}

QUERIES = {
    f.__name__: Query(small_batches(f), SQL.get(f.__name__))
    for f in (
        op1_minhash_dedup, op2_license_scan, op3_packing, op4_suffix_dedup, op5_toxicity, op6_importance,
        op7_decontaminate, op8_language_id, op9_order_minhash, op10_lm_scoring, op11_label_propagation, op12_merkle_manifest,
        op13_orchard,
    )
}
