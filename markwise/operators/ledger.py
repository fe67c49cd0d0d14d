"""Resumable prediction: pending work, cached rows, upserts, batch prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pending(
    conversations: DataFrame,
    done: DataFrame,
    key: str = "conv_id",
    override: DataFrame | None = None,
    override_key: str = "question_no",
    ok: Column | None = None,
) -> DataFrame:
    """Conversations without a stored answer, plus those of overridden questions.

    With ``ok`` a stored answer only counts when the condition holds. The keys
    of the done table are made distinct before the join.
    """
    stored = (done if ok is None else done.filter(ok)).select(key).distinct()
    if override is None:
        return conversations.join(stored, key, "left_anti")
    flags = conversations.join(stored.withColumn("_done", F.lit(True)), key, "left").join(
        override.select(override_key).distinct().withColumn("_again", F.lit(True)), override_key, "left"
    )
    return flags.filter("_done IS NULL OR _again").drop("_done", "_again").select(*conversations.columns)


def cached_lookup(
    fresh: DataFrame, cache: DataFrame, keys: Sequence[str], ordinal: str, value: Sequence[str]
) -> DataFrame:
    """Fresh rows with ``value`` columns from the first cached row equal in any key.

    "Equal in one key or another" would be a nested loop as one join. Instead
    the first cached row per key value is found by aggregation, each key is
    joined on its own, and the smallest ordinal wins. A miss keeps the fresh row;
    ``cache_hit`` tells which is which.
    """
    out = fresh
    picks = []
    for i, key in enumerate(keys):
        best = cache.groupBy(F.col(key).alias(f"_key{i}")).agg(
            F.min(F.struct(F.col(ordinal).alias("_ord"), *value)).alias(f"_hit{i}")
        )
        out = out.join(best, F.col(key) == F.col(f"_key{i}"), "left")
        picks.append(F.col(f"_hit{i}"))
    hit = F.least(*picks) if len(picks) > 1 else picks[0]
    out = out.withColumn("_hit", hit)
    rest = [c for c in fresh.columns if c not in value]
    return out.select(
        *rest,
        *[F.when(F.col("_hit").isNotNull(), F.col(f"_hit.{v}")).otherwise(F.col(v)).alias(v) for v in value],
        F.col("_hit").isNotNull().alias("cache_hit"),
    )


def upsert(
    old: DataFrame, new: DataFrame, key: str, ordinal: str, insert_missing: bool = False
) -> DataFrame:
    """Replace the first old row of each key by the newest new row.

    New rows of unknown keys are dropped, or added with ``insert_missing``. Both
    frames carry ``ordinal``; a replaced row keeps the place of the old one.
    """
    body = [c for c in old.columns if c != ordinal]
    newest = new.groupBy(key).agg(F.max_by(F.struct(*body), ordinal).alias("_new"))
    first = old.groupBy(key).agg(F.min(ordinal).alias("_first"))
    targets = first.join(newest, key).select(
        F.col(key).alias("_key"), F.col("_first"), F.col("_new")
    )
    replaced = old.join(
        targets, (F.col(key) == F.col("_key")) & (F.col(ordinal) == F.col("_first")), "left"
    ).select(
        *[
            F.col(c) if c == ordinal
            else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            for c in old.columns
        ]
    )
    if not insert_missing:
        return replaced
    added = new.join(first.select(key), key, "left_anti")
    return replaced.unionByName(added.select(*old.columns))


def upsert_by_any_key(
    store: DataFrame, fresh: DataFrame, keys: Sequence[str], override: bool = False
) -> DataFrame:
    """Insert fresh rows that match no stored row in any key.

    With ``override`` matching stored rows are removed and all fresh rows put.
    ``fresh`` must not repeat a key value.
    """
    if override:
        kept = store
        for key in keys:
            kept = kept.join(fresh.select(key).distinct(), key, "left_anti")
        return kept.select(*store.columns).unionByName(fresh)
    added = fresh
    for key in keys:
        added = added.join(store.select(key).distinct(), key, "left_anti")
    return store.unionByName(added.select(*store.columns))


def upsert_conversations(
    store: DataFrame, fresh: DataFrame, override: bool = False, key: str = "conv_id", path: str = "qid_flat",
    ordinal: str = "ordinal",
) -> tuple[DataFrame, DataFrame]:
    """The store after rendering ``fresh`` conversations, and a report of one row per fresh row.

    A conversation belongs to the question file named by the last but one step of its path. Without ``override`` a fresh
    conversation whose key is stored is left out. With it, the stored conversations of the same file go, whatever
    their key, and the newest fresh one of each file and key comes in. Fresh rows come by ``ordinal``; of equal keys the first
    (with ``override`` the last) counts. The report has ``clash`` (the key was taken), ``stored`` (is it in the store now?) and
    ``n_replaced``: how many stored rows it replaces, so a row that hits several is seen.
    """
    steps = F.split(path, "/")
    file = F.when(F.size(steps) > 1, F.element_at(steps, -2))
    body = [c for c in fresh.columns if c != ordinal]
    picked = (F.max_by if override else F.min_by)(F.struct(*body), ordinal)
    last = (F.max if override else F.min)(ordinal)
    rank = fresh.withColumn("_file", file)
    if override:  # of one file the newest row stays
        newest = rank.groupBy("_file").agg(F.max(ordinal).alias("_newest"))
        rank = rank.join(newest, rank["_file"].eqNullSafe(newest["_file"])).drop(newest["_file"])
        rank = rank.withColumn("_newest", (F.col("_newest") == F.col(ordinal)) | F.col("_file").isNull())
    else:
        rank = rank.withColumn("_newest", F.lit(True))
    chosen = rank.filter("_newest").groupBy(key).agg(picked.alias("_row"), last.alias("_place"))

    old = store.withColumn("_file", file)
    if override:
        files = rank.filter("_file IS NOT NULL").select("_file").distinct()
        gone, kept = old.join(files, "_file", "left_semi"), old.join(files, "_file", "left_anti")
        per_file = gone.groupBy("_file").agg(F.count(F.lit(1)).alias("_n_file"))
    else:
        kept, per_file = old, old.select("_file").limit(0).withColumn("_n_file", F.lit(0).cast("long"))
    taken = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n_key"))

    report = rank.join(taken, key, "left").join(per_file, "_file", "left").join(chosen.select(key, "_place"), key, "left")
    clash = F.col("_n_key").isNotNull()
    chosen_row = F.col("_newest") & (F.col("_place") == F.col(ordinal))
    stored = F.coalesce(chosen_row if override else chosen_row & ~clash, F.lit(False))
    replaced = F.coalesce("_n_file", F.lit(0)) + F.when(F.lit(override), F.coalesce("_n_key", F.lit(0))).otherwise(0)
    report = report.select(
        *fresh.columns, clash.alias("clash"), stored.alias("stored"), F.when(stored, replaced).otherwise(0).cast("long").alias("n_replaced")
    )
    added = chosen.select("_row.*")
    if override:
        kept = kept.join(added.select(key), key, "left_anti")
    else:
        added = added.join(taken, key, "left_anti")
    return kept.select(*store.columns).unionByName(added.select(*store.columns)), report


def predict(
    rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str
) -> DataFrame:
    """Run a user's predictor over pending rows in Arrow batches, per partition."""
    return rows.mapInPandas(fn, schema)
