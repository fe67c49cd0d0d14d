"""Part graphs seen through frames.

``frame_parts``: frame columns, furniture_id, part_id (and what the selection
needs). ``edges``: furniture_id, src, dst in both directions. Part ids are
ordered as numbers. What is joined by furniture and part is broadcast: it is the
furniture's vocabulary, and a shuffle by so few keys would leave a few tasks all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(part: str | Column) -> Column:
    return (F.col(part) if isinstance(part, str) else part).cast("long")


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing; empty for a sound graph."""
    back = edges.select("furniture_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["furniture_id", "src", "dst"], "left_anti")


def visible_edges(frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Edges with both ends in the frame, once, lower part id first."""
    seen = frame_parts.select(*frame, "furniture_id", "part_id").distinct()
    out = edges.filter(number("src") < number("dst")).select("furniture_id", "src", "dst").distinct()
    starts = seen.withColumnRenamed("part_id", "src").join(F.broadcast(out), ["furniture_id", "src"])
    return starts.join(
        seen.withColumnRenamed("part_id", "dst"), [*frame, "furniture_id", "dst"], "left_semi"
    ).select(*frame, "furniture_id", "src", "dst")


def with_neighbours(frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Per frame and part: ``connected`` and ``unconnected`` visible parts.

    The arrays hold distinct parts of one furniture, so its vocabulary of parts
    bounds them whatever the number of rows.
    """
    seen = frame_parts.select(*frame, "furniture_id", "part_id").distinct()
    shown = seen.groupBy(*frame, "furniture_id").agg(F.collect_set("part_id").alias("_shown"))
    near = edges.groupBy("furniture_id", F.col("src").alias("part_id")).agg(
        F.collect_set("dst").alias("_near")
    )
    rows = seen.join(shown, [*frame, "furniture_id"]).join(F.broadcast(near), ["furniture_id", "part_id"], "left")
    none = F.expr("array()").cast("array<" + dict(seen.dtypes)["part_id"] + ">")
    near_set = F.coalesce("_near", none)
    return rows.select(
        *frame, "furniture_id", "part_id",
        F.array_intersect("_shown", near_set).alias("connected"),
        F.array_except(
            F.array_except("_shown", near_set), F.array("part_id")
        ).alias("unconnected"),
    )


def non_edges(frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Unordered pairs of visible parts that are not connected.

    Built from each part's set difference, so nothing but the result is emitted.
    """
    rows = with_neighbours(frame_parts, edges, frame)
    later = F.filter("unconnected", lambda p: number(p) > number("part_id"))
    return rows.select(
        *frame, "furniture_id", F.col("part_id").alias("src"), F.explode(later).alias("dst")
    )


def clean_pairs(pairs: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Model-reported pairs: ends sorted by number, distinct, no loops, both ends known."""
    sorted_ = number("src") <= number("dst")
    tidy = (
        pairs.select(
            *by, F.when(sorted_, F.col("src")).otherwise(F.col("dst")).alias("src"),
            F.when(sorted_, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        )
        .filter("src <> dst")
        .distinct()
    )
    for end in ("src", "dst"):
        tidy = tidy.join(parts.select(*by, F.col("part_id").alias(end)), [*by, end], "left_semi")
    return tidy.select(*by, "src", "dst")


def _priority(strategy: str, seed: int, key: list[str]) -> Column:
    if strategy == "size_h2l":
        return -F.col("area")
    if strategy == "size_l2h":
        return F.col("area")
    if strategy == "subasm":
        return F.col("subasm_size")
    if strategy == "random":
        return F.md5(F.concat_ws("|", F.lit(seed), *key))
    raise ValueError(f"unknown strategy {strategy!r}")


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group and their place ``pick``; every task keeps ``k`` rows a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.withColumn("_place", place).filter(F.col("_place") <= k)
    return first.withColumn("pick", F.col("_place").cast("long") - 1).drop("_place")


def pick_parts(
    frame_parts: DataFrame, frame: Sequence[str], strategy: str = "size_h2l", k: int = 3, seed: int = 42
) -> DataFrame:
    """The first ``k`` parts of each frame by area or sub-assembly size; adds ``pick``.

    Ties go to the lower part id.
    """
    key = [*frame, "part_id"]
    ranked = frame_parts.withColumns(
        {"_by": _priority(strategy, seed, key), "_no": number("part_id")}
    )
    return first_of(ranked, frame, ["_by", "_no"], k).drop("_by", "_no")


def pick_pairs(
    frame_parts: DataFrame, frame: Sequence[str], strategy: str = "size_h2l", k: int = 3, seed: int = 42
) -> DataFrame:
    """The first ``k`` pairs of each frame by summed area or sub-assembly size.

    With ties settled by the parts' own ranks, a pair that uses the part of rank
    r is beaten by at least r - 1 others. The best k pairs thus lie among the
    first k + 1 parts, and only those are paired.
    """
    if strategy == "random":
        raise ValueError("pairs are picked by size or sub-assembly")
    weight = {"size_h2l": -F.col("area"), "size_l2h": F.col("area"), "subasm": F.col("subasm_size")}[strategy]
    top = pick_parts(frame_parts, frame, strategy, k + 1, seed).withColumn("_w", weight)
    item = F.struct(F.col("pick"), F.col("part_id"), F.col("_w"))
    lists = top.groupBy(*frame, "furniture_id").agg(F.array_sort(F.collect_list(item)).alias("_top"))
    pairs = F.flatten(
        F.transform(
            "_top",
            lambda a: F.transform(
                F.filter("_top", lambda b: b["pick"] > a["pick"]),
                lambda b: F.struct(
                    (a["_w"] + b["_w"]).alias("w"), a["pick"].alias("i"), b["pick"].alias("j"),
                    a["part_id"].alias("part_a"), b["part_id"].alias("part_b"),
                ),
            ),
        )
    )
    best = F.slice(F.array_sort(pairs), 1, k)
    return lists.select(*frame, "furniture_id", F.posexplode(best).alias("pair_pick", "_p")).select(
        *frame, "furniture_id", F.col("pair_pick").cast("long").alias("pick"), "_p.part_a", "_p.part_b"
    )
