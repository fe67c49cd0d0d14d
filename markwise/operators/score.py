"""Scoring of multiple-choice attempts: tallies, modes and chance baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = "micro_avg"


def with_question_ids(df: DataFrame, path: str = "qid_flat") -> DataFrame:
    """Add ``question_no`` and ``shuff_idx`` from the last two parts of the path id."""
    parts = F.split(F.col(path), "/")
    return df.withColumns(
        {"question_no": F.element_at(parts, -2), "shuff_idx": F.element_at(parts, -1).cast("int")}
    )


def filter_shuffles(df: DataFrame, n: int | None = None) -> DataFrame:
    """Keep the first ``n`` option shuffles of each question; ``None`` keeps all."""
    return df if n is None else df.filter(F.col("shuff_idx") < n)


def is_correct(prediction: Column, truth: Column) -> Column:
    """A missing prediction counts as the empty string."""
    return F.coalesce(prediction, F.lit("")) == truth


def tally(
    df: DataFrame,
    key_cols: Sequence[str] = ("question_no",),
    first: Sequence[str] = (),
    ordinal: str | None = None,
) -> DataFrame:
    """Count right and wrong attempts per question.

    ``first`` columns come from the first row of the question by ``ordinal``.
    One aggregation with map-side combine: a question with a huge number of
    attempts is reduced before the shuffle.
    """
    ok = is_correct(F.col("prediction"), F.col("truth"))
    aggs = [F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect")]
    if first:
        aggs.append(F.min_by(F.struct(*first), F.col(ordinal)).alias("_first"))
    out = df.groupBy(*key_cols).agg(*aggs)
    return out.select(
        *key_cols, "correct", "incorrect", *[F.col(f"_first.{c}").alias(c) for c in first]
    )


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("long"))


def score(
    tallies: DataFrame,
    by: Sequence[str] = (),
    strict_schema: bool = False,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Strict / majority / any accuracy and chance levels, per category and micro.

    ``tallies`` has one row per question with ``category, truth, n_options,
    correct, incorrect`` and the ``by`` columns, such as a run id. All rows are
    reduced to one row per (category, truth label) in a single shuffle; every
    figure, the micro row included, comes from that small table.
    """
    parts = ["n", "strict", "majority", "any", "chance"]
    cells = tallies.groupBy(*by, "category", "truth").agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("incorrect") == 0).alias("strict"),
        _count(F.col("correct") > F.col("incorrect")).alias("majority"),
        _count(F.col("correct") > 0).alias("any"),
        F.sum(F.lit(100.0) / F.col("n_options")).alias("chance"),
    )
    # Each small row counts for its category and for the micro row; no second read of the input.
    both = F.explode(F.array(F.col("category"), F.lit(MICRO)))
    n = F.sum("n")
    out = (
        cells.withColumn("category", both)
        .groupBy(*by, "category", "truth")
        .agg(*[F.sum(c).alias(c) for c in parts])
        .groupBy(*by, "category")
        .agg(
            n.alias("n_questions"),
            *[(100.0 * F.sum(c) / n).alias(c) for c in ("strict", "majority", "any")],
            (F.sum("chance") / n).alias("random_chance"),
            (100.0 * F.max("n") / n).alias("freq_chance"),
        )
    )
    return require_categories(out, categories) if strict_schema else out


def require_categories(scores: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The report in the given category order; a missing category is an error."""
    wanted = scores.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(categories)], "report_order int, category string"
    )
    present = scores.withColumn("_present", F.lit(True))
    return (
        # one row per requested category: a literal list
        present.join(F.broadcast(wanted), "category", "right")
        .withColumn(
            "category",
            F.when(F.col("_present"), F.col("category")).otherwise(
                F.raise_error(F.concat(F.lit("category missing from the report: "), "category"))
            ),
        )
        .drop("_present")
        .orderBy("report_order")
    )


def binary_category(df: DataFrame, raw_truth: str = "raw_truth") -> DataFrame:
    """Report yes/no questions by their true answer instead of their category."""
    return df.withColumn("category", F.lower(F.col(raw_truth)))
