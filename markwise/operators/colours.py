"""Max-min choice of contrasting colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions import colour
from markwise.session import settle

REFERENCE_BLOCK = 1_000
#: Candidates of a group that meet its references in one task, on average.
CANDIDATE_BLOCK = 2_000


def _point(metric: str) -> Column:
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    return colour.lab(*rgb) if metric == "lab" else colour.luminance(*rgb)


def _distance(metric: str, p: Column, q: Column) -> Column:
    return colour.lab_distance(p, q) if metric == "lab" else colour.contrast_ratio(p, q)


def maxmin_pick(
    candidates: DataFrame, references: DataFrame, by: Sequence[str], ordinal: str, metric: str = "lab",
    rounds: int = 1, block: int = REFERENCE_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """Per group the candidate whose smallest distance to the references is largest.

    First by ``ordinal`` on ties; each further round counts the picks so far as
    references. ``candidates`` and ``references`` hold r, g, b in [0, 1].

    A colour that repeats among the references adds nothing, so they are made
    distinct and packed into arrays of at most ``block``: a candidate meets one
    row per block, never one row per reference. A group of many candidates is
    dealt over shares by hash, and its reference blocks and picks go to each share.
    """
    if metric not in ("lab", "wcag"):
        raise ValueError(f"unknown metric {metric!r}")
    distinct = references.select(*by, "r", "g", "b").distinct()
    # Spread by hash into enough blocks; the block count follows the group's size.
    sizes = distinct.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * 2 / block).alias("_blocks"))
    packed = (
        distinct.join(sizes, list(by))
        .groupBy(*by, F.pmod(F.xxhash64("r", "g", "b"), F.col("_blocks")).alias("_block"))
        .agg(F.collect_list(_point(metric)).alias("_refs"))
    )
    counts = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > candidate_block)
    # One row per group with more than a share of candidates.
    wide = counts.select(*by, F.ceil(F.col("_n") / candidate_block).alias("_shares"))
    share = F.pmod(F.xxhash64(ordinal), F.coalesce("_shares", F.lit(1)))

    def to_shares(df: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1)
        return df.join(wide, list(by), "left").withColumn("_share", F.explode(every)).drop("_shares")

    cand = candidates.select(*by, ordinal, "r", "g", "b").join(wide, list(by), "left").withColumns(
        {"_share": share, "_point": _point(metric)}
    ).drop("_shares")
    shared = [*by, "_share"]
    nearest = F.array_min(F.transform("_refs", lambda q: _distance(metric, F.col("_point"), q)))
    scored = (
        cand.join(to_shares(packed.drop("_block")), shared)
        .groupBy(*shared, ordinal)
        .agg(F.min(nearest).alias("min_distance"), *[F.first(c).alias(c) for c in ("r", "g", "b", "_point")])
    )
    picks = None
    for no in range(rounds):
        if rounds > 1:
            scored = settle(scored)
        best = scored.groupBy(*by).agg(
            F.max_by(
                F.struct(ordinal, "r", "g", "b", "min_distance", "_point"),
                F.struct("min_distance", -F.col(ordinal)),
            ).alias("_best")
        )
        row = best.select(
            *by, F.lit(no).alias("round"),
            *[F.col(f"_best.{c}").alias(c) for c in (ordinal, "r", "g", "b", "min_distance")],
        )
        picks = row if picks is None else picks.unionByName(row)
        if no + 1 < rounds:
            chosen = to_shares(best.select(*by, F.col("_best._point").alias("_chosen")))
            scored = scored.join(chosen, shared).withColumn(
                "min_distance",
                F.least("min_distance", _distance(metric, F.col("_point"), F.col("_chosen"))),
            ).drop("_chosen")
    return picks
